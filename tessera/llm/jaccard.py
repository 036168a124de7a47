"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts with equal n-gram sets form a class first, so copies cost one row each.
Classes are shuffled on their band hashes; what shares a band is compared by
sketches, 16 bits of each of the bands' minima, and a pair goes on if its sketches
agree in as many places as a pair exactly at the threshold does with probability
``RECALL``.  The components of those pairs are the candidate groups, so texts that
merely share a template meet in a band and part again.  Within a candidate group
pairs are verified on their whole sets.  Large bands and large groups are dealt out
as pairs of blocks, bounded in rows and in bytes, each a task's work; what leaves a
task is a count for each class and the edges of a spanning forest.

Bands: the most rows whose bands, as many as reach ``RECALL`` at the threshold,
need at most ``MOST_HASHES`` hashes.

Edge cases: words are separated by ASCII white space; a text of fewer words than
``N`` has one n-gram of all its words; null, empty and blank texts have none and
link with nothing; repeated or null doc_ids are told apart row by row, and the
class id is then null only if all of a class's ids are; columns beyond the id and
the text are ignored, and pass through ``first_of_classes`` whatever their names; a
very long text is one large set; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import durable, free_names, partitions_for
from tessera.llm.graph import components, every, released, with_uid

N = 5
THRESHOLD = 0.8
RECALL = 0.999999
MOST_HASHES = 128
#: Classes, and bytes of their sets, in a block of a large candidate group; classes in a block of a large band.
BLOCK, BLOCK_BYTES, BAND_BLOCK = 512, 16 << 20, 1024
#: Classes of more rows than this share of all are met by broadcast, so there are at most as many of them.
HOT_CLASSES = 10_000
#: Bits of the bitmap by which texts in no candidate group stay where they are, and the most candidates for which it is made.
BITS, MOST_MARKED = 1 << 27, 20_000_000
CHUNK = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows)."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Word and n-gram hashes of many texts at once, from prefix sums of a polynomial in the bytes."""

    def __init__(self, n: int = N, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.table = n, rng.integers(0, 2**64, 256, np.uint64)
        self.coef = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.power = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(_BASE, -1, 2**64)
            self.inverse = np.cumprod(steps, dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's sorted distinct n-gram hashes."""
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._grow(len(buf) + 1)
        ink = ~self.space[buf]
        edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
        if ink[0]:
            edge = np.concatenate([[0], edge])
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.power[: len(buf)], dtype=np.uint64, out=sums[1:])
        word = mix64((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(first, ends)
        grams = np.zeros(max(0, len(word) - self.n + 1), np.uint64)
        for k in range(self.n):
            grams += word[k : k + len(grams)] * self.coef[k]
        grams = mix64(grams)
        out, lo = [], 0
        for hi in upto.tolist():
            if hi - lo >= self.n:
                out.append(np.unique(grams[lo : hi - self.n + 1]))
            elif hi > lo:
                out.append(mix64(np.array([(word[lo:hi] * self.coef[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            lo = hi
        return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int = 2) -> np.ndarray:
    """(texts, bands * rows) 16 bits of each minimum; a band is equal where its ``rows`` numbers are. The sets must not be empty."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**64, bands * rows, np.uint64)
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, tmp = np.zeros((len(sets), bands * rows), np.uint16), np.empty_like(flat)
    for k in range(bands * rows):
        np.multiply(flat, mul[k], out=tmp)
        np.add(tmp, add[k], out=tmp)
        out[:, k] = mix64(np.minimum.reduceat(tmp, start))
    return out


def least_agreement(places: int, threshold: float, recall: float) -> int:
    """The most places in which sketches of a pair at the threshold agree with the wanted probability."""
    tail = 0.0
    for k in range(places, -1, -1):
        tail += math.comb(places, k) * threshold**k * (1 - threshold) ** (places - k)
        if tail >= recall:
            return k
    return 0


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK):
    """(first row, texts as bytes) of runs of about ``most`` bytes."""
    at, texts, size = 0, [], 0
    for t in batch.column(column):
        texts.append((t.as_py() or "").encode())
        size += len(texts[-1]) + 1
        if size >= most:
            yield at, texts
            at, texts, size = at + len(texts), [], 0
    if texts:
        yield at, texts


def signatures(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """texts: _uid, text. _uid, digest (null without n-grams), grams, bands (hashes by place), sketch (all minima)."""

    def run(batches):
        hasher = Hasher(n)
        for batch in batches:
            uid = batch.column(0)
            for at, some in chunks(batch, 1):
                sets = hasher(some)
                full = [s for s in sets if len(s)]
                minima = band_hashes(full, bands, rows) if full else np.zeros((0, bands * rows), np.uint16)
                keys = np.zeros((len(full), bands), np.uint64)
                for k in range(rows):  # the place is part of the hash, so bands of different places meet nowhere
                    keys = mix64(keys * np.uint64(_BASE) + minima[:, k::rows] + np.arange(bands, dtype=np.uint64) * np.uint64(k == 0))
                sig = iter(zip(keys.view(np.int64), minima, strict=True))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [next(sig) if len(s) else (None, None) for s in sets]
                sketch = [None if m is None else m.tobytes() for _, m in sigs]
                yield pa.RecordBatch.from_arrays([uid.slice(at, len(some)), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([b for b, _ in sigs], pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["_uid", "digest", "grams", "bands", "sketch"])

    return texts.mapInArrow(released(run), "_uid long, digest binary, grams long, bands array<long>, sketch binary")


def agreeing(sketch: np.ndarray, group: np.ndarray, place: np.ndarray, rows: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows of the arrays) by which, over all bands, agreeing pairs connect what they connect; groups are runs of rows.

    Rows that agree with their group's first are one component by that; only what
    is left is compared with the whole group, so a group of near copies costs a
    comparison for each row.  A pair that is equal in an earlier band met there, so
    its edge is left out here.
    """
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(cut, len(group)))
    own = np.repeat(np.arange(len(cut)), size)

    def near(x, y):
        """Which pairs agree, and are equal in no band before theirs."""
        same = sketch[x] == sketch[y]
        ok = np.count_nonzero(same, axis=1) >= least
        met = same.reshape(len(same), -1, rows).all(2)
        return ok, ok & ~(met & (np.arange(met.shape[1]) < place[y][:, None])).any(1)

    a, b, apart = [], [], []
    for k in range(0, len(group), 1 << 14):
        x = np.arange(k, min(len(group), k + (1 << 14)))
        first = cut[own[x]]
        ok, new = near(first, x)
        new &= first != x
        a.append(first[new])
        b.append(x[new])
        apart += x[~ok & (size[own[x]] > 2)].tolist()
    for u in apart:
        y = np.arange(cut[own[u]], cut[own[u]] + size[own[u]])
        y = y[near(np.full(len(y), u), y)[1] & (y != u)]
        a.append(np.full(len(y), u))
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def sketched(work: DataFrame, rows: int, least: int) -> DataFrame:
    """work: band, i, j, place, node, sketch, sorted by the first three. Edges a-b between nodes."""

    def keys(batch):
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])

    def run(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None or not rest.num_rows else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = keys(rest)
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if len(new):  # the last group may go on in the next batch
                yield emit(rest.slice(0, int(new[-1])))
                rest = rest.slice(int(new[-1]))
        if rest is not None and rest.num_rows:
            yield emit(rest)

    def emit(batch):
        key = keys(batch)
        group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
        node, place = batch.column(4).to_numpy(), batch.column(3).to_numpy()
        sketch = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(len(node), -1)
        a, b = (node[x] for x in agreeing(sketch, group, place, rows, least))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return work.mapInArrow(released(run), "a long, b long")


def linked(sizes: np.ndarray, flat: np.ndarray, start: np.ndarray, sketch: np.ndarray, least: int, lo: int, hi: int, threshold: float):
    """For each row before ``hi``, the later rows from ``lo`` on that are near enough."""
    vocab, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(vocab), bool)
    for i in range(hi):
        first = max(i + 1, lo)
        other = np.arange(first, len(sizes))
        ok = (sizes[other] >= threshold * sizes[i]) & (sizes[i] >= threshold * sizes[other])
        other = other[ok]
        if len(other):
            other = other[np.count_nonzero(sketch[other] == sketch[i], axis=1) >= least]
        if not len(other):
            continue
        own = flat[start[i] : start[i] + sizes[i]]
        mark[own] = True
        if 2 * len(other) > len(sizes) - first:
            at = start[first]
            common = np.add.reduceat(mark[flat[at:]].astype(np.int32), start[first:] - at)[other - first]
        else:
            common = np.array([mark[flat[start[j] : start[j] + sizes[j]]].sum() for j in other])
        mark[own] = False
        union = sizes[i] + sizes[other] - common
        # exact for thresholds of a few decimals
        yield i, other[common * 10_000 >= round(threshold * 10_000) * union]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def verified(work: DataFrame, threshold: float, least: int) -> DataFrame:
    """work: cluster, i, j, block, _uid, n, sketch, grams, blocks, in groups of cluster, i and j.

    Rows: a with its links; or a and its root b (links -1), where the group is whole in one block; or an edge a-b (links 0).
    """

    def close(rows, i, j):
        rows.sort(key=lambda r: (r[0] != i, r[1]))
        seen, kept = set(), []
        for r in rows:
            if r[1] not in seen:
                seen.add(r[1])
                kept.append(r)
        sets = [np.frombuffer(r[4], np.uint64) for r in kept]
        sizes = np.array([len(s) for s in sets])
        start = np.cumsum(sizes) - sizes
        sketch, n = np.stack([np.frombuffer(r[3], np.uint16) for r in kept]), np.array([r[2] for r in kept])
        split = sum(r[0] == i for r in kept)
        links, forest, edges = np.zeros(len(kept), np.int64), Forest(len(kept)), []
        for x, ys in linked(sizes, np.concatenate(sets), start, sketch, least, 0 if i == j else split, split, threshold):
            if len(ys):
                links[x] += n[ys].sum()
                links[ys] += n[x]
                edges += [(x, y) for y in ys.tolist() if forest.join(x, y)]
        uid = [r[1] for r in kept]
        out = [(uid[k], None, int(links[k])) for k in np.flatnonzero(links)]
        if kept[0][5] == 1:
            return out + [(uid[k], uid[forest.find(k)], -1) for k in np.flatnonzero(links)]
        return out + [(uid[x], uid[y], 0) for x, y in edges]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if r[:3] != key:
                    if len(rows) > 1:
                        out += close(rows, *key[1:])
                    key, rows = r[:3], []
                rows.append(r[3:])
            yield emit(out)
        yield emit(close(rows, *key[1:]) if len(rows) > 1 else [])

    def emit(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "links"])

    return work.mapInArrow(released(run), "a long, b long, links long")


def blocked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with node, blocks: each in all pairs (i, j) of its block with the others of its group, and its block."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o").select(*by, "i", "j", *[c for c in rows.columns if c not in (*by, "o")])


def marked(t: DataFrame, nodes: DataFrame, bits: int = BITS, most: int = MOST_MARKED) -> DataFrame:
    """The rows of ``t`` (_uid) that may be among ``nodes`` (node), by a bitmap of 32 bits a node; all rows where the nodes are many.

    The bitmap has at most ``bits`` bits, whatever the input.
    """
    if (count := nodes.count()) > most:
        return t
    bits = min(bits, 1 << max(15, (32 * count).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = nodes.select(at("node").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("map"))
    place = F.bitmap_bit_position(at("_uid"))
    byte = F.conv(F.hex(F.substring("map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = (F.bitmap_bucket_number(at("_uid")) == F.col("bucket")) & (byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0)
    return t.join(F.broadcast(maps), hit, "left_semi")


def candidate_groups(reps: DataFrame, rows: int, least: int) -> DataFrame:
    """node, cluster of the classes with a partner: components of the pairs that share a band and agree in their sketches."""
    banded = reps.select("node", F.posexplode("bands").alias("place", "band"))
    large = banded.groupBy("band").agg(F.ceil(F.count("*") / BAND_BLOCK).cast("int").alias("blocks"), F.count("*").alias("k")).filter("k > 1").drop("k")
    hits = banded.join(large, "band").join(reps.select("node", "sketch"), "node")
    work = blocked(hits, ["band"]).select("band", "i", "j", "place", "node", "sketch")
    parts = partitions_for(reps)
    dealt = work.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    return durable(components(sketched(dealt, rows, least)).select("node", F.col("root").alias("cluster")))


def rejoined(sig: DataFrame, node: DataFrame, rows: int) -> DataFrame:
    """Each row of ``sig`` with its class (digest, root, n, links); rows without n-grams stand alone.

    Of the classes at most HOT_CLASSES have more than a HOT_CLASSES-th of the rows:
    those travel to the rows, and no task gathers a hot class.
    """
    bare = sig.filter("digest is null").select("_uid", F.col("_uid").alias("root"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("links"))
    full, hot = sig.filter("digest is not null").select("_uid", "digest"), F.col("n") > max(64, rows // HOT_CLASSES)
    if node.filter(hot).isEmpty():
        return full.join(node, "digest").drop("digest").unionByName(bare)
    large = F.broadcast(node.filter(hot))
    warm = full.join(large, "digest").drop("digest")
    cold = full.join(large.select("digest"), "digest", "left_anti").join(node.filter(~hot), "digest").drop("digest")
    return warm.unionByName(cold).unionByName(bare)


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the component), n_links (documents linked directly), n_copies (equal sets, itself included), and _uid."""
    bands, rows = bands_for(threshold, recall)
    least = least_agreement(bands * rows, threshold, recall)
    t, same = with_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", ["text"])
    parts = partitions_for(t)
    sig = durable(signatures(t.select("_uid", "text"), n, bands, rows))
    first = sig.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("_uid", "grams", "bands", "sketch")).alias("s"), F.count("*").alias("n"))
    reps = durable(first.select("digest", F.col("s._uid").alias("node"), "n", "s.grams", "s.bands", "s.sketch"))

    group = candidate_groups(reps, rows, least)
    chosen = reps.select("node", "n", "grams", "sketch").join(group, "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("grams") * 8 / BLOCK_BYTES)).cast("int")
    chosen = chosen.drop("grams").join(chosen.groupBy("cluster").agg(blocks.alias("blocks")), "cluster")
    work = marked(t, group).select(F.col("_uid").alias("node"), "text").join(chosen, "node").select("cluster", "blocks", "node", "n", "sketch", "text")

    def grams(batches):
        hasher = Hasher(n)
        for batch in batches:
            for at, some in chunks(batch, 5):
                sets = [s.tobytes() for s in hasher(some)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(some)).columns[:5], pa.array(sets, pa.binary())], ["cluster", "blocks", "node", "n", "sketch", "grams"])

    made = work.mapInArrow(released(grams), "cluster long, blocks int, node long, n long, sketch binary, grams binary")
    dealt = blocked(made, ["cluster"]).select("cluster", "i", "j", "block", "node", "n", "sketch", "grams", "blocks")
    dealt = dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = durable(verified(dealt, threshold, least))

    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    root = found.filter("links = -1").select(F.col("a").alias("node"), F.col("b").alias("root"))
    apart = found.filter("links = 0 and b is not null")
    if not apart.isEmpty():
        root = root.unionByName(components(apart))
    node = reps.select("digest", "node", "n").join(links, "node", "left").join(root, "node", "left")
    node = durable(node.select("digest", F.coalesce("root", "node").alias("root"), "n", F.coalesce("links", F.lit(0)).alias("links")))
    final = rejoined(sig, node, sig.count())
    # the least row of a component has its least id
    if same:
        final = final.withColumns({"doc_id": F.col("_uid"), "class_id": F.col("root")})
    else:
        own = t.select("_uid", "doc_id")
        final = final.join(own, "_uid").join(own.select(F.col("_uid").alias("root"), F.col("doc_id").alias("class_id")), "root")
    return final.select("doc_id", "class_id", (F.col("n") - 1 + F.col("links")).alias("n_links"), F.col("n").alias("n_copies"), "_uid")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with the least id of their class, and all that have no n-gram; all columns stay, whatever their names."""
    uid = free_names(docs, "_uid")[0]
    t, _ = with_uid(docs, id_col, [text_col], uid)
    first = jaccard_join(t.select(F.col(uid).alias("doc_id"), F.col(text_col).alias("text")), **how).filter("doc_id = class_id").select(F.col("doc_id").alias(uid))
    return t.join(first, uid, "left_semi").select(*every(docs))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's class and number of near-duplicates: five words, similarity 0.8."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
