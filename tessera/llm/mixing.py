"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Targets: water-filling.  A source's target is min(cap * size, level * weight),
where the level is the largest of the levels that result if the sources with the
lowest cap-to-weight ratios are held at their caps.

Rates: each document gets the rate in (0, cap) that keeps the whole closest in
relative entropy to rate 1, subject to the sources' token totals.  The convex
dual has one multiplier for each source and tilts the odds of a document's rate
exponentially in its size, rate / (cap - rate) = exp(m * size / mean) / (cap - 1).
Newton steps, kept in a bracket, run on the histogram of (source, size), so an
iteration reads a table far smaller than the documents.

Copies: documents of one source and size have one rate, so their copies are
rounded together, by systematic selection along the sizes; then each source moves
copies of one size that bring it closer.  All of this happens on the histogram.
Documents are touched once, to deal a size's copies out by hash, and never
exchanged by source alone, so no task holds a hot source.

Edge cases: null texts and texts without words have size 0 and take 0; a null
source is a source of its own, the last; repeated rows count one by one; an empty
table gives no rows; a very long text is one large size.  Results depend on no row order and no partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable, free, free_names
from tessera.llm.graph import every, with_uid

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Documents of one size that are ranked together.
BUCKET_ROWS = 1_000
#: Newton steps that one plan takes before the driver asks whether all sources are done, and the plans after which it gives up.
STEPS_A_ROUND, ROUNDS = 4, 50
TOLERANCE = 1e-7
DIGITS = 10
#: The most rows of a table that travels to every task.
BROADCAST_ROWS = 20_000
#: Rates are rounded to this part before they are summed, so sums are exact.
UNIT = 1 << 20
KEY = ["s", "s_null"]


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    t = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
        F.col(source_col).isNull().alias("s_null"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("hash"),
    )
    return t.select("doc_id", *KEY, "size", F.xxhash64("doc_id", "hash").alias("mark"))


def targets(stats: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """stats: s, s_null, source_size; one row for each source, so single-partition windows hold sources only."""
    by_name, by_level, whole = Window.orderBy("s_null", "s"), Window.orderBy("ratio", "s_null", "s"), Window.partitionBy(F.lit(0))
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = stats.withColumn("weight", F.get(w, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    t = t.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    t = t.withColumn("all", F.sum("source_size").over(whole) * float(share)).withColumn("all_w", F.sum("weight").over(whole))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    held, held_w = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("most", "weight"))
    t = t.withColumn("level", F.max((F.col("all") - held) / (F.col("all_w") - held_w)).over(whole))
    return t.select(*KEY, "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def step(hist: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One Newton step of every source's multiplier, halved into its bracket where it leaves it."""
    z = F.col("size") / F.col("mean")
    rate = float(cap) / (1 + (cap - 1) * F.exp(-F.col("m") * z))
    x = F.col("n") * F.col("size")
    sums = hist.join(state, KEY).groupBy(*KEY, "target", "mean", "m", "lo", "hi").agg(F.sum(x * rate).alias("g"), F.sum(x * z * rate * (1 - rate / cap)).alias("h"))
    under = F.col("g") < F.col("target")
    lo, hi = F.when(under, F.col("m")).otherwise(F.col("lo")), F.when(under, F.col("hi")).otherwise(F.col("m"))
    sums = sums.withColumn("lo", lo).withColumn("hi", hi).withColumn("off", F.abs(F.col("g") / F.col("target") - 1))
    to = F.col("m") + F.try_divide(F.col("target") - F.col("g"), F.col("h"))
    wide = F.col("m") + F.when(F.col("g") < F.col("target"), 1.0).otherwise(-1.0) * (1 + F.abs("m"))
    inside = to.isNotNull() & (F.col("lo").isNull() | (to > F.col("lo"))) & (F.col("hi").isNull() | (to < F.col("hi"))) & (F.abs(to - F.col("m")) <= 4 * (1 + F.abs("m")))
    half = F.when(F.col("lo").isNull() | F.col("hi").isNull(), wide).otherwise((F.col("lo") + F.col("hi")) / 2)
    # a bracket as narrow as the digits that are kept cannot be halved
    done = (F.col("off") < TOLERANCE) | (F.col("hi") - F.col("lo") <= 2 * 10.0**-DIGITS * (1 + F.abs("m")))
    new = F.when(done, F.col("m")).when(inside, to).otherwise(half)
    return sums.select(*KEY, "target", "mean", F.round(new, DIGITS).alias("m"), "lo", "hi", F.coalesce(done, F.lit(False)).alias("done"))


def solve(hist: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """The dual's multiplier for each source; a source that is at its cap or has no words has none.

    A bracketed step at least halves the bracket, so every source ends; the limit
    on the rounds is an error, never a result.
    """
    open_ = (F.col("target") < F.col("source_size") * float(cap) * (1 - 1e-12)) & (F.col("target") > 0)
    none = F.lit(None).cast("double")
    state = durable(goal.filter(open_).select(*KEY, "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("m"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("done")))
    for _ in range(ROUNDS):
        if state.filter("not done").isEmpty():
            return state.select(*KEY, "mean", "m")
        new = state
        for _ in range(STEPS_A_ROUND):
            new = step(hist, new, cap)
        new = durable(new)
        free(state)
        state = new
    raise RuntimeError("the dual has not converged")


def rounded(hist: DataFrame, goal: DataFrame, dual: DataFrame, cap: float = CAP) -> DataFrame:
    """hist with target, rate and copies, all of a size's documents together; systematic selection along the sizes."""
    t = hist.join(goal.select(*KEY, "source_size", "target"), KEY).join(dual, KEY, "left")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("m").isNull(), F.when(F.col("target") > 0, float(cap)).otherwise(0.0)).otherwise(float(cap) / (1 + (cap - 1) * F.exp(-F.col("m") * F.col("size") / F.col("mean"))))
    t = t.withColumn("rate", rate).withColumn("part", F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long") * F.col("n"))
    end = F.sum("part").over(Window.partitionBy(*KEY).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)) + UNIT // 2
    extra = F.floor(end / UNIT) - F.floor((end - F.col("part")) / UNIT)
    return t.withColumn("copies", (F.floor("rate") * F.col("n") + extra).cast("long")).select(*KEY, "size", "n", "source_size", "target", "rate", "copies")


def nearer(t: DataFrame, cap: int) -> DataFrame:
    """Copies more or less of one size in each source, the size that brings it nearest to its target."""
    short = t.groupBy(*KEY).agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    t = t.join(short, KEY)
    room = F.when(F.col("short") > 0, F.col("n") * int(cap) - F.col("copies")).otherwise(F.col("copies"))
    k = F.least(room, F.round(F.abs("short") / F.col("size")).cast("long"))
    by_size = t.filter("size > 0").withColumn("k", k).filter("k > 0").withColumn("miss", F.abs(F.abs("short") - F.col("k") * F.col("size"))).filter(F.col("miss") < F.abs("short"))
    best = by_size.groupBy(*KEY).agg(F.min(F.struct("miss", "size", "k")).alias("b")).select(*KEY, F.col("b.size").alias("size"), F.col("b.k").alias("k"))
    moved = t.join(best, [*KEY, "size"], "left")
    return moved.withColumn("copies", F.col("copies") + F.coalesce(F.signum("short").cast("long") * F.col("k"), F.lit(0))).drop("short", "k")


def dealt(base: DataFrame, plan: DataFrame, bucket_rows: int) -> DataFrame:
    """Each document with its share of its size's copies: the even part, and one more for the first by hash.

    A size's documents lie in as many buckets as they need, and a bucket knows how
    many lie before it, so no task holds a hot source or size.
    """
    plan = plan.withColumn("buckets", F.ceil(F.col("n") / bucket_rows).cast("long"))
    # sizes of more than one bucket are at most one in bucket_rows documents; where they are few they travel to the documents
    large = plan.filter("buckets > 1").select(*KEY, "size", "buckets")
    if (count := large.count()) <= BROADCAST_ROWS:
        large = F.broadcast(large)
    t = base if not count else base.join(large, [*KEY, "size"], "left")
    bucket = F.pmod("mark", F.coalesce("buckets", F.lit(1))) if count else F.lit(0).cast("long")
    t = t.select(*base.columns, bucket.alias("bucket"))
    before = t.groupBy(*KEY, "size", "bucket").agg(F.count("*").alias("k"))
    before = before.withColumn("before", F.sum("k").over(Window.partitionBy(*KEY, "size").orderBy("bucket")) - F.col("k")).drop("k")
    by_bucket = [*KEY, "size", "bucket"]
    # one exchange for the joins and the window; a whole partition of small sizes is a task
    t = t.join(before.join(plan, [*KEY, "size"]), by_bucket)
    nth = F.row_number().over(Window.partitionBy(*by_bucket).orderBy("mark", "doc_id")) + F.col("before")
    even = F.floor(F.col("copies") / F.col("n"))
    return t.withColumn("copies", (even + F.when(nth <= F.col("copies") - even * F.col("n"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken; also source, rate and copies."""
    base = durable(sizes(docs, id_col, text_col, source_col))
    hist = durable(base.groupBy(*KEY, "size").agg(F.count("*").alias("n")))
    stats = hist.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goal = durable(targets(stats, weights, share, cap).join(stats.select(*KEY, "docs"), KEY))
    dual = solve(hist, goal, cap)
    plan = rounded(hist, goal, dual, cap)
    for _ in range(3):
        plan = durable(nearer(plan, cap))
    t = dealt(base, plan, BUCKET_ROWS)
    return t.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.when(~F.col("s_null"), F.col("s")).alias("source"), "rate", "copies")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay, whatever their names."""
    uid, copies = free_names(docs, "_uid", "_copies")
    t, _ = with_uid(docs, id_col, [text_col], uid)
    taken = mix(t.select(F.col(uid).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), **how)
    taken = taken.filter("copies > 0").select(F.col("doc_id").alias(uid), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(copies))
    return t.join(taken, uid).withColumn(copies, F.explode(copies)).select(*every(docs))


def op3_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: 150 % of all words, weights 5, 2, 1 repeating."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
