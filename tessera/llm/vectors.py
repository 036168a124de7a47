"""Embedding near-dedup by collision-counting projections.

Within a label, vectors are projected on ``PROJECTIONS`` random directions, each
projection is sorted, and a query's window in it is centred on the query's own
value.  A pair is verified by its cosine if it shares at least as many windows as
a pair exactly at the threshold shares with probability ``RECALL`` (a binomial
tail: the windows hold ``SPREADS`` standard deviations of such a pair's distance).

Equal vectors of a label form one node first.  A label's nodes are dealt out in
blocks, and every pair of blocks is a task's work: the label decides the work,
never the size of a task.  What leaves a task is a count for each node and the
edges of a spanning forest.

The method reads every query's windows, so its work within one label grows with
the square of that label's distinct vectors, whatever the number of machines.

Edge cases: null or zero vectors, and those with null or non-finite parts, link
with nothing, as do rows with a null label; vectors of different lengths link not;
repeated and null ids are told apart row by row; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.llm.graph import components, with_uid
from tessera.llm.jaccard import Forest

COSINE = 0.98
PROJECTIONS = 24
SPREADS = 2.0
RECALL = 0.999999
BLOCK = 2048
QUERIES = 64


def least_collisions(m: int = PROJECTIONS, spreads: float = SPREADS, recall: float = RECALL) -> int:
    """The most collisions that a pair at the threshold reaches with the wanted probability."""
    p, tail = math.erf(spreads / math.sqrt(2)), 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def candidates(a: np.ndarray, b: np.ndarray, cosine: float, m: int, spreads: float, recall: float, same: bool):
    """(i, j) arrays of pairs with enough collisions; unit vectors; i < j where both blocks are one."""
    rng = np.random.default_rng(a.shape[1])
    axes = rng.normal(size=(a.shape[1], m))
    half = spreads * math.sqrt(2 - 2 * cosine)
    pa_, pb = a @ axes, b @ axes
    order = np.argsort(pb, axis=0)
    rank = np.empty((m, len(b)), np.uint16)
    lo, n = np.empty((m, len(a)), np.uint16), np.empty((m, len(a)), np.uint16)
    for k in range(m):
        s = pb[order[:, k], k]
        rank[k, order[:, k]] = np.arange(len(b))
        first = np.searchsorted(s, pa_[:, k] - half)
        lo[k], n[k] = first, np.searchsorted(s, pa_[:, k] + half, side="right") - first
    least = least_collisions(m, spreads, recall)
    for q in range(0, len(a), QUERIES):
        count = np.zeros((min(QUERIES, len(a) - q), len(b)), np.uint8)
        for k in range(m):
            # unsigned, so what lies before the window is beyond it too
            count += (rank[k][None, :] - lo[k, q : q + QUERIES, None]) < n[k, q : q + QUERIES, None]
        i, j = np.nonzero(count >= least)
        i += q
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j


def linked_blocks(rows: DataFrame, cosine: float, m: int, spreads: float, recall: float) -> DataFrame:
    """rows: label, dim, i, j, block, node, n, vector, by label, dim, i and j."""

    def close(some, i, j):
        some.sort(key=lambda r: (r[0] != i, r[1]))
        v = np.array([np.frombuffer(r[3], np.float64) for r in some])
        n, split = np.array([r[2] for r in some]), sum(r[0] == i for r in some)
        u = v / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(1, keepdims=True)
        same = i == j
        shift = 0 if same else split
        links, forest, edges = np.zeros(len(some), np.int64), Forest(len(some)), []
        if len(u[:split]) and len(u[shift:]):
            for x, y in candidates(u[:split], u[shift:], cosine, m, spreads, recall, same):
                y = y + shift
                near = np.einsum("ij,ij->i", u[x], u[y]) >= cosine
                x, y = x[near], y[near]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                edges += [(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if forest.join(p, q)]
        node = [r[1] for r in some]
        return [(node[k], None, int(links[k])) for k in np.flatnonzero(links)] + [(node[p], node[q], 0) for p, q in edges]

    def emit(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "links"])

    def run(batches):
        key, some = None, []
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if r[:4] != key:
                    out += close(some, *key[2:]) if len(some) > 1 else []
                    key, some = r[:4], []
                some.append(r[4:])
            yield emit(out)
        yield emit(close(some, *key[2:]) if len(some) > 1 else [])

    return rows.mapInArrow(run, "a long, b long, links long")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS, spreads: float = SPREADS, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (least id reached) and kept."""
    t, same = with_uid(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")), "vec_id", ["label"])
    t = t.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero only
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    t = durable(t.withColumn("good", F.coalesce(good, F.lit(False))))
    nodes = durable(t.filter("good").groupBy("label", "v").agg(F.min("_uid").alias("node"), F.count("*").alias("n")))
    sized = nodes.withColumn("dim", F.size("v"))
    blocks = sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("node").alias("l"))
    sized = sized.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = sized.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def bits(batches):
        for batch in batches:
            raw = pa.array([np.asarray(x, np.float64).tobytes() for x in batch.column(7).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], raw], batch.schema.names)

    pairs = pairs.select("l", "dim", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "n", F.col("v").alias("vector"))
    pairs = pairs.mapInArrow(bits, "l long, dim int, i int, j int, block int, node long, n long, vector binary")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "l", "dim", "i", "j").sortWithinPartitions("l", "dim", "i", "j")
    found = durable(linked_blocks(dealt, cosine, projections, spreads, recall))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    root = components(found.filter("b is not null"))
    node = nodes.join(links, "node", "left").join(root, "node", "left").select("label", "v", "n", "links", F.coalesce("root", "node").alias("root"))
    got = t.select("_uid", "vec_id", F.when(F.col("good"), F.col("label")).alias("label"), "v").join(node, ["label", "v"], "left")
    got = got.withColumn("root", F.coalesce("root", "_uid"))
    if same:
        got = got.withColumn("component_id", F.col("root"))
    else:
        got = got.join(t.select(F.col("_uid").alias("root"), F.col("vec_id").alias("component_id")), "root")
    return got.select("vec_id", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", (F.col("_uid") == F.col("root")).alias("kept"))


def op9_collision_counting(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of a label, at cosine 0.98."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
