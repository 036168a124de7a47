"""Work that is no table: functions over items on the executors, retries, and bounded chunks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession


def chunked(items: Iterable, size: int) -> Iterator[list]:
    if size < 1:
        raise ValueError("a chunk has one item at least")
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def array_chunks(array: np.ndarray, size: int, axis: int = 0) -> Iterator[np.ndarray]:
    """Views of at most ``size`` along an axis; a memory-mapped array is read a chunk at a time."""
    if size < 1:
        raise ValueError("a chunk has one row at least")
    for k in range(0, array.shape[axis], size):
        yield array[(slice(None),) * (axis % array.ndim) + (slice(k, k + size),)]


@dataclass(frozen=True)
class Retryable:
    """A function that is tried again on the named errors, after a wait that doubles."""

    function: Callable
    attempts: int = 3
    wait: float = 0.1
    errors: tuple[type[BaseException], ...] = (OSError,)

    def __call__(self, *args, **kwargs):
        for k in range(self.attempts):
            try:
                return self.function(*args, **kwargs)
            except self.errors:
                if k == self.attempts - 1:
                    raise
                time.sleep(self.wait * 2**k)


class SparkMapper:
    """Items are dealt to the executors, a task for each ``chunk`` of them; results come back in the items' order.

    The items and the results are the driver's; what is large should be a table.
    """

    def __init__(self, spark: SparkSession, chunk: int = 1):
        self.spark, self.chunk = spark, chunk

    def map(self, function: Callable, items: Iterable) -> Iterator:
        rows = [(i, bytearray(cloudpickle.dumps(x))) for i, x in enumerate(items)]
        if not rows:
            return iter(())
        code = cloudpickle.dumps(function)

        def run(batches):
            import pandas as pd

            f = cloudpickle.loads(code)
            for b in batches:
                yield pd.DataFrame({"i": b["i"], "x": [cloudpickle.dumps(f(cloudpickle.loads(bytes(x)))) for x in b["x"]]})

        df = self.spark.createDataFrame(rows, "i long, x binary").repartitionByRange(-(-len(rows) // self.chunk), "i")
        done = df.mapInPandas(run, "i long, x binary").orderBy("i").collect()
        return (cloudpickle.loads(bytes(r.x)) for r in done)


def run_batch(function: Callable, items: Iterable, mapper=None) -> list:
    """Here, or where a mapper says."""
    return list(mapper.map(function, items) if mapper else map(function, items))
