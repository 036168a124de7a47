"""Row identities and connected components as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.durable import durable, free, free_names, partitions_for


def every(df: DataFrame) -> list:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def released(run):
    """``run`` over batches, and what Arrow keeps for reuse given back at its end, as workers go on to other stages."""

    def whole(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def map_in_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` by place and not by name, as names may hold dots."""
    plain = lambda n: [f"c{i}" for i in range(n)]
    fields = [T.StructField(c, f.dataType) for c, f in zip(plain(len(schema)), schema, strict=True)]
    return df.toDF(*plain(len(df.columns))).mapInArrow(released(run), T.StructType(fields)).toDF(*schema.names)


def with_uid(df: DataFrame, id_col: str, order: list[str], uid: str = "_uid") -> tuple[DataFrame, bool]:
    """Adds ``uid`` (long): the id itself where ids are unique and not null, else a number that rises with the id (nulls last); and which of both.

    Repeated ids are ordered by a hash of ``order``, then by their place.  Rows are
    dealt by ranges of all three, so neither a null nor a hot id gathers in a task,
    and a row's number is its partition's with its place there.
    """
    ids = df.groupBy(F.col(id_col).cast("long").alias("i")).agg(F.count("*").alias("n"))
    if ids.filter("n > 1 or i is null").isEmpty():
        return df.withColumn(uid, F.col(id_col).cast("long")), True
    place = free_names(df, "_place")[0]
    key = [F.col(id_col).cast("long").asc_nulls_last(), F.xxhash64(*order), F.col(place)]
    ranged = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(partitions_for(df), *key).sortWithinPartitions(*key)
    return durable(ranged.select(*every(df), F.monotonically_increasing_id().alias(uid))), False


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node reached.

    Alternating large and small stars: each round moves every node to the least of
    its neighbours, so the rounds grow with the logarithm of the longest path.  A
    hub's many larger neighbours meet its least one in a join, which Spark splits
    where it is skewed; only a node's smaller neighbours, which are few, share a frame.
    It ends when every node has one edge, to a node that has none of its own.
    """
    e = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    ends = lambda e: e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    while not ends(e).groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or up + root > 1").isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        moved = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        last, e = e, durable(small.select(moved.alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        free(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
