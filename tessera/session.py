"""Session construction and the few settings every plan relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Applied where the caller has not decided otherwise.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and single-node benches."""
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "8g"),
    }
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf | extra).getOrCreate()
