"""Best-fit packing of documents into fixed-length training sequences.

Tokens are counted per document on the executors; only the histogram of piece
lengths (at most ``capacity`` numbers, whatever the input's size) reaches the
driver.  There the instance is reduced by Martello and Toth's dominance
procedure, the rest is packed best-fit decreasing, both on lengths with
multiplicities, and the plan (a few intervals for each length) goes back to the
executors, where every piece finds its place from its rank among the pieces of
its length.

Edge cases: a null or empty text is one piece that holds only the end id;
repeated rows and repeated or null doc_ids are packed one by one; an empty table
gives no rows; columns of the input other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.llm.graph import released

CAPACITY = 1024
END_ID = 2
#: Rows that one task ranks at a time.
RANK_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Texts beyond these characters, or with a special token's string, take the reference tokenizer; it is
#: slower, and only there could the two libraries' character classes differ.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ſ‘-”…]|<\|")


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit bytes.

    The vocabulary file for ``tokenizers`` decides the ids.  Where the same
    vocabulary is given as ranks, plain texts take the faster library, which
    yields equal ids (a test compares both).
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        self.path, self.slow, self.fast = path, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not PLAIN.search(text):
            core = getattr(self.fast, "_core_bpe", None)
            if hasattr(core, "encode_to_tiktoken_buffer"):
                return bytes(core.encode_to_tiktoken_buffer(text, set()))
            return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()
        if self.slow is None:  # most tasks need it not, and it is large
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[tuple, Encoder] = {}


def public_vocabulary(name: str = "byte_bpe_50k.json") -> dict[str, str | None]:
    """Paths of a public tokenizer's files, looked up where the code runs."""
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken") if name == "byte_bpe_50k.json" else None
    return {"path": P.path(name), "ranks_path": ranks, "pattern": P.PATTERN if ranks else None}


def pieces(docs: DataFrame, vocabulary: dict | str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; only documents over ``capacity`` are cut, and their first piece may be shorter."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        given = public_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
        key = tuple(sorted(given.items(), key=str))
        if key not in _encoders:
            _encoders[key] = Encoder(**given)
        encode = _encoders[key]
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1), strict=True):
                buf = encode(text.as_py() or "") + end
                n = len(buf) // 4
                at = 0
                size = n if n <= capacity else n % capacity or capacity
                k = 0
                while at < n:
                    rows.append((doc, k, at, size, zlib.crc32(buf[4 * at : 4 * (at + size)])))
                    at, k, size = at + size, k + 1, capacity
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(cut), PIECES)


@dataclass
class Bins:
    """Equal bins: how many, what is left in each, and the lengths in them."""

    n: int
    left: int
    items: list[int] = field(default_factory=list)


def dominance_reduction(counts: Counter, capacity: int) -> list[Bins]:
    """Fix the sets of at most three pieces that dominate every other set with their largest piece.

    A set with piece j dominates another if a packing with the other can be
    changed, piece by piece for pieces no larger, into one with the first and no
    more bins.  ``counts`` keeps what could not be fixed.
    """
    fixed: list[Bins] = []
    changed = True
    while changed:
        changed = False
        for j in sorted((s for s, n in counts.items() if n), reverse=True):
            while counts[j]:
                room = capacity - j
                small = sorted(s for s, n in counts.items() if n and s <= room)
                free = lambda s, used: counts[s] - used.count(s)
                lowest: list[int] = []
                for s in small:
                    while len(lowest) < 3 and free(s, [j, *lowest]) > 0:
                        lowest.append(s)
                    if len(lowest) == 3:
                        break
                fit = 0
                while fit < len(lowest) and sum(lowest[: fit + 1]) <= room:
                    fit += 1
                best = next((s for s in reversed(small) if free(s, [j]) > 0), None)
                if fit == 0:
                    chosen = [j]
                elif fit == 1 or j + best == capacity:
                    chosen = [j, best]
                elif fit == 2:
                    a, b = _best_pair(small, counts, j, room)
                    if best >= a + b:
                        chosen = [j, best]
                    elif a == best and (b == best or _only_pair(small, counts, j, room, a, b)):
                        chosen = [j, a, b]
                    else:
                        break
                else:
                    break
                need = Counter(chosen)
                n = min(counts[s] // k for s, k in need.items())
                for s, k in need.items():
                    counts[s] -= n * k
                fixed.append(Bins(n, capacity - sum(chosen), chosen))
                changed = True
    return fixed


def _best_pair(small: list[int], counts: Counter, j: int, room: int) -> tuple[int, int]:
    """The two further pieces, larger first, that fill the room best."""
    top, a, b = -1, 0, 0
    small = [s for s in small if counts[s] > (s == j)]
    hi = len(small) - 1
    for lo, s in enumerate(small):
        hi = max(hi, lo)
        while hi > lo and s + small[hi] > room:
            hi -= 1
        for t in {small[hi], small[max(hi - 1, 0)], s}:
            need = Counter([j, s, t])
            if s + t <= room and all(counts[x] >= k for x, k in need.items()) and (s + t > top or (s + t == top and max(s, t) > a)):
                top, a, b = s + t, max(s, t), min(s, t)
    return a, b


def _only_pair(small: list[int], counts: Counter, j: int, room: int, a: int, b: int) -> bool:
    """No two pieces larger than b, without this a, have room beside j: the smaller of any pair is then at most b."""
    need, above = Counter([j, a]), []
    for s in small:
        if s > b:
            above += [s] * min(2, max(0, counts[s] - need[s]))
        if len(above) >= 2:
            break
    return len(above) < 2 or above[0] + above[1] > room


def best_fit_decreasing(counts: Counter, capacity: int) -> list[Bins]:
    """Best-fit decreasing on lengths with multiplicities; as many kinds of bins as lengths, nearly."""
    by_left: dict[int, list[Bins]] = {}
    lefts: list[int] = []
    full: list[Bins] = []

    def put(b: Bins) -> None:
        if b.n == 0:
            return
        if b.left == 0:
            full.append(b)
            return
        if b.left not in by_left:
            by_left[b.left] = []
            bisect.insort(lefts, b.left)
        by_left[b.left].append(b)

    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[s]
        while n:
            k = bisect.bisect_left(lefts, s)
            if k < len(lefts):
                b = by_left[lefts[k]].pop()
                if not by_left[lefts[k]]:
                    del by_left[lefts.pop(k)]
            else:
                b = Bins(-(-n // (capacity // s)), capacity)
            each = b.left // s
            whole = min(b.n, n // each)
            put(Bins(whole, b.left - each * s, b.items + [s] * each))
            n -= whole * each
            if whole < b.n:
                rest = b.n - whole
                if n and n < each:
                    put(Bins(1, b.left - n * s, b.items + [s] * n))
                    n, rest = 0, rest - 1
                put(Bins(rest, b.left, b.items)) if b.items else None
    return full + [b for bs in by_left.values() for b in bs]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): where pieces of that rank on go."""
    left = Counter(counts)
    bins = dominance_reduction(left, capacity) + best_fit_decreasing(left, capacity)
    ranks, sequence, out = Counter(), 0, {}
    for b in bins:
        at = 0
        for s in b.items:
            out.setdefault(s, []).append((ranks[s], sequence, at))
            ranks[s] += b.n
            at += s
        sequence += b.n
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: dict | str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset; sequences are gapless from offset 0."""
    cut = durable(pieces(docs, vocabulary, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = plan(counts, capacity)
    groups = max(1, -(-sum(counts.values()) // RANK_ROWS))
    salted = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = salted.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = before.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, ["length", "group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                rows, at = where[int(s)], np.flatnonzero(length == s)
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                seq[at] = rows[k, 1] + rank[at] - rows[k, 0]
                off[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(released(place), f"{PIECES}, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 1024 tokens."""
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
