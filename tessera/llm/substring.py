"""Exact substring dedup: every byte of a long string that also starts earlier is removed.

Suffixes are sorted per shard by external induced sorting (``suffix``).  What may
share a string of ``LENGTH`` bytes is brought together first: each window of that
many bytes owns its least-hashed inner string of ``INNER`` bytes, its anchor, so
equal windows have equal anchors.  Runs of windows with one anchor are segments.

1. Anchors are dealt by hash; one that occurs once ends here, and its windows stand.
   What a task sees often it passes on at once and reports by one mark, so a hot
   anchor costs few rows for each task; whatever has a mark is hot everywhere.
2. The texts meet their repeated anchors and cut the segments out.  Equal segments
   meet: only the earliest is sorted.  Segments of hot anchors are cut in shorter
   runs that are dealt by the bytes all their windows share, so none draws a third
   of the rows into a shard.
3. Each shard sorts its segments' suffixes; places that share ``LENGTH`` symbols
   with an earlier one are repeats.
4. The texts meet their repeats and are measured and hashed without them.

Everything between tasks is compressed columns in rows of a bucket and a task; a
bucket's size does not grow with the input, the number of buckets does.

Edge cases: null texts count as empty; of repeated rows the first stays; repeated
and null ids are ordered by text (nulls last); columns beyond the id and the text
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import input_bytes, partitions_for
from tessera.llm import blobs, suffix
from tessera.llm.graph import with_uid
from tessera.llm.jaccard import _BASE, _M1, _M2, chunks, mix64

LENGTH = 100
INNER = 50
#: Occurrences from which an anchor's segments are cut in runs of HOT_RUN windows: in all, or in one chunk of a task.
HOT = 1024
HOT_CHUNK = 16
HOT_RUN = 8
#: Hashes that a task remembers as hot; beyond them each chunk reports anew.
MEMORY = 1 << 20
#: Bytes of input for each bucket of anchors, and of texts and segments.
ANCHOR_BYTES, TEXT_BYTES = 1 << 20, 2 << 20
BUDGET = 256 << 20
MARK = np.iinfo(np.int64).min
#: Bytes of a hash that are kept; within a bucket they tell anchors apart, and a mistake only adds a segment.
KEPT = 5


def pack_entries(u, first, more, place, h, *warm) -> bytes:
    """Documents as differences, as they come in order, and the lower bytes of the hashes."""
    low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].T)
    return blobs.pack(np.diff(u.astype("<i8"), prepend=np.int64(0)), first.astype("<i4"), more, place, low.reshape(-1), *warm)


def unpack_entries(blob: bytes, warm: bool) -> list[np.ndarray]:
    d, first, more, place, low, *rest = blobs.unpack(blob, "<i8", "<i4", "u1", "u1", "u1", *["u1"] * warm)
    h = np.zeros((len(d), 8), np.uint8)
    h[:, :KEPT] = low.reshape(KEPT, -1).T
    return [np.cumsum(d), first, more, place, h.view("<u8").reshape(-1), *rest]


class Anchors:
    """Segments of many texts at once: (text, first window, windows less one, anchor's place in the first, anchor's hash)."""

    def __init__(self, length: int = LENGTH, inner: int = INNER):
        rng = np.random.default_rng(7)
        self.length, self.inner, self.table = length, inner, rng.integers(0, 2**64, 256, np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.power = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(_BASE, -1, 2**64)
            self.inverse = np.cumprod(steps, dtype=np.uint64)

    def pieces(self, texts: list[bytes], most: int = 1 << 23):
        """(text, offset, bytes): long texts in overlapping pieces that hold each window once."""
        for k, t in enumerate(texts):
            for at in range(0, max(1, len(t) - self.length + 1), most):
                yield k, at, t[at : at + most + self.length - 1]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        out, held, size = [], [], 0
        for p in self.pieces(texts):
            if len(p[2]) >= self.length:
                held.append(p)
                size += len(p[2])
                if size >= 1 << 21:
                    out.append(self._some(held))
                    held, size = [], 0
        if held:
            out.append(self._some(held))
        if not out:
            return tuple(np.zeros(0, t) for t in ("<i8", "<i4", "<u1", "<u1", "<u8"))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _some(self, pieces):
        buf = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        n = len(buf)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[buf] * self.power[:n], dtype=np.uint64, out=sums[1:])
        v = (sums[self.inner :] - sums[: -self.inner]) * self.inverse[: n - self.inner + 1]
        v = (v ^ (v >> np.uint64(29))) * _M1
        v ^= v >> np.uint64(32)
        # hash above, place below: the least is the leftmost of equal strings
        low = (v & ~np.uint64((1 << 24) - 1)) | np.arange(len(v), dtype=np.uint64)
        width, m = 1, low
        want = self.length - self.inner + 1
        while 2 * width <= want:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < want:
            m = np.minimum(m[: len(m) - (want - width)], m[want - width :])
        at = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
        sizes = np.array([len(p[2]) for p in pieces])
        begin = np.cumsum(sizes) - sizes
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        new[begin] = True
        whole = np.zeros(n + 1, np.int8)
        np.add.at(whole, begin, 1)
        np.add.at(whole, begin + sizes - self.length + 1, -1)
        whole = np.cumsum(whole[: len(at)]).astype(bool)
        stop = np.flatnonzero(whole[:-1] & ~whole[1:]) + 1
        new[stop] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        ok = whole[first]
        first, last = first[ok], last[ok]
        piece = np.searchsorted(begin, first, side="right") - 1
        text, shift = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        return text[piece], (first - begin[piece] + shift[piece]).astype("<i4"), (last - first).astype("<u1"), (at[first] - first).astype("<u1"), v[at[first]]


def bucket_of(uid: np.ndarray, n: int) -> np.ndarray:
    return (mix64(np.asarray(uid, np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def texts_by_bucket(t: DataFrame, n_docs: int, kind: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            uid, out = batch.column(0).to_numpy(zero_copy_only=False), []
            for at, some in chunks(batch, 1, 8 << 20):
                ids = uid[at : at + len(some)]
                for b, (k,) in blobs.split(bucket_of(ids, n_docs), np.arange(len(some))):
                    size = np.array([len(some[i]) for i in k], "<i8")
                    out.append((b, kind, blobs.pack(ids[k].astype("<i8"), size, np.frombuffer(b"".join(some[i] for i in k), np.uint8))))
            yield blobs.rows(out)

    return t.select("_uid", "text").mapInArrow(run, blobs.SCHEMA)


def read_texts(blob: bytes):
    uid, size, body = blobs.unpack(blob, "<i8", "<i8", "u1")
    end = np.cumsum(size)
    body = body.tobytes()
    for u, a, b in zip(uid.tolist(), (end - size).tolist(), end.tolist(), strict=True):
        yield u, body[a:b]


def repeated_anchors(t: DataFrame, length: int, inner: int, n_anchor: int, n_docs: int, partitions: int, hot: int) -> DataFrame:
    """By bucket of documents: the segments of anchors that occur more than once, with a mark where they are hot."""

    def report(batches):
        make, known = Anchors(length, inner), np.zeros(0, np.uint64)
        for batch in batches:
            uid, out = batch.column(0).to_numpy(zero_copy_only=False), []
            for at, some in chunks(batch, 1, 8 << 20):
                text, first, more, place, h = make(some)
                if not len(h):
                    continue
                u = uid[at + text].astype("<i8")
                got, n = np.unique(h, return_counts=True)
                often = got[n >= HOT_CHUNK]
                twice = np.isin(h, np.union1d(often, known))
                fresh = np.setdiff1d(often, known)
                if len(known) + len(fresh) <= MEMORY:
                    known = np.union1d(known, fresh)
                marks = fresh
                b = (h >> np.uint64(20)) % np.uint64(n_anchor)
                one = ~twice
                cols = (u, first, more, place, h)
                for k, c in blobs.split(b[one].astype(np.int64), *(c[one] for c in cols)):
                    out.append((k, 0, pack_entries(*c)))
                for k, (c,) in blobs.split(((marks >> np.uint64(20)) % np.uint64(n_anchor)).astype(np.int64), marks):
                    none = np.zeros(len(c), "<i8")
                    out.append((k, 0, pack_entries(none + MARK, none, none.astype("<u1"), none.astype("<u1"), c)))
                for k, c in blobs.split(n_anchor + bucket_of(u[twice], n_docs), *(c[twice] for c in cols)):
                    out.append((k, 1, pack_entries(*c, np.ones(len(c[0]), "<u1"))))
            yield blobs.rows(out)

    def count(batches):
        for bucket, found in blobs.grouped(batches):
            if bucket >= n_anchor:
                for _, v in found:
                    yield blobs.rows([(bucket - n_anchor, 0, v)])
                continue
            cols = [np.concatenate(c) for c in zip(*(unpack_entries(v, False) for _, v in found), strict=True)]
            _, which, n = np.unique(cols[4], return_inverse=True, return_counts=True)
            marked = np.bincount(which, weights=cols[0] == MARK)
            warm, again = ((marked > 0) | (n >= hot))[which], (n > 1)[which] & (cols[0] != MARK)
            cols = [c[again] for c in (*cols, warm.astype("<u1"))]
            yield blobs.rows([(b, 0, pack_entries(*c)) for b, c in blobs.split(bucket_of(cols[0], n_docs), *cols)])

    return blobs.dealt(t.select("_uid", "text").mapInArrow(report, blobs.SCHEMA), partitions).mapInArrow(count, blobs.SCHEMA)


def cut_segments(body: bytes, first, more, place, h, hot, length: int):
    """(key, first window, windows less one, bytes); hot segments in runs counted from the anchor."""
    for s, m, p, k, warm in zip(first.tolist(), more.tolist(), place.tolist(), h.tolist(), hot.tolist(), strict=True):
        if not warm:
            yield k, s, m, body[s : s + m + length]
            continue
        anchor, end = s + p, s + m
        while s <= end:
            run = (anchor - s) // HOT_RUN
            last = min(end, anchor - run * HOT_RUN)
            core = body[anchor - run * HOT_RUN : anchor - run * HOT_RUN - HOT_RUN + 1 + length]
            yield int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little"), s, last - s, body[s : last + length]
            s = last + 1


def segments(entries: DataFrame, texts: DataFrame, length: int, n_shards: int, n_docs: int, partitions: int) -> DataFrame:
    """By shard: distinct segments (kind 0); by n_shards + bucket of documents: repeats known already (kind 1)."""

    def run(batches):
        for bucket, found in blobs.grouped(batches):
            held, cols, seen, known = [], None, {}, []
            out = {}
            size = 0
            for kind, v in found:
                if kind == 0:
                    held.append(unpack_entries(v, True))
                    continue
                if cols is None:
                    if not held:
                        continue
                    cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                    order = np.lexsort((cols[1], cols[0]))
                    cols = [c[order] for c in cols]
                for u, body in read_texts(v):
                    lo, hi = np.searchsorted(cols[0], [u, u + 1])
                    for key, s, m, part in cut_segments(body, *(c[lo:hi] for c in cols[1:]), length):
                        mark = hashlib.blake2b(part, digest_size=16).digest()
                        if mark in seen:
                            a = seen[mark]
                            if a <= (u, s):
                                known.append((u, s, m))
                                continue
                            # documents come in any order; the earlier one takes the place
                        seen[mark] = (u, s)
                        out.setdefault(key % n_shards, []).append((u, s, m, part))
                        size += len(part)
                if size > 8 << 20:
                    yield blobs.rows([(b, 0, pack_segments(rows)) for b, rows in out.items()])
                    out, size = {}, 0
            done = [(b, 0, pack_segments(rows)) for b, rows in out.items()]
            if known:
                done.append((n_shards + bucket, 1, blobs.pack(*(np.array(c, t) for c, t in zip(zip(*known, strict=True), ("<i8", "<i4", "<i4"), strict=True)))))
            yield blobs.rows(done)

    return blobs.dealt(entries.unionByName(texts), partitions).mapInArrow(run, blobs.SCHEMA)


def pack_segments(rows) -> bytes:
    u, s, m, parts = zip(*rows, strict=True)
    return blobs.pack(np.array(u, "<i8"), np.array(s, "<i4"), np.array(m, "<i4"), np.frombuffer(b"".join(parts), np.uint8))


def shard_repeats(segs: DataFrame, length: int, n_shards: int, n_docs: int, partitions: int, budget: int) -> DataFrame:
    """By bucket of documents: runs of windows (document, first, more) that start earlier somewhere."""

    def run(batches):
        for bucket, found in blobs.grouped(batches):
            if bucket >= n_shards:
                for _, v in found:
                    yield blobs.rows([(bucket - n_shards, 0, v)])
                continue
            us, ss, ms, parts = [], [], [], []
            for _, v in found:
                u, s, m, body = blobs.unpack(v, "<i8", "<i4", "<i4", "u1")
                body, end = body.tobytes(), np.cumsum(m.astype(np.int64) + length)
                parts += [body[a:b] for a, b in zip((end - m - length).tolist(), end.tolist(), strict=True)]
                us, ss, ms = [*us, u], [*ss, s], [*ms, m]
            u, s, m = np.concatenate(us), np.concatenate(ss), np.concatenate(ms)
            order = np.lexsort((s, u))
            u, s, m = u[order], s[order], m[order]
            keep, seen, again = [], set(), np.zeros(len(u), bool)
            for k, i in enumerate(order.tolist()):
                if parts[i] in seen:
                    again[k] = True
                else:
                    seen.add(parts[i])
                    keep.append(i)
            out = [(u[again], s[again], m[again])]
            u, s, m = u[~again], s[~again], m[~again]
            body = np.frombuffer(bytes([255]).join(parts[i] for i in keep) + bytes([255]), np.uint8)
            del parts, seen
            # 255 is in no UTF-8 text
            text = np.append(np.where(body == 255, suffix.SEPARATOR, body + np.uint8(suffix.SHIFT)).astype(np.uint8), np.uint8(suffix.SENTINEL))
            place = suffix.repeats(text, length, budget).astype(np.int64)
            begin = np.cumsum(m.astype(np.int64) + length + 1) - (m + length + 1)
            seg = np.searchsorted(begin, place, side="right") - 1
            at = place - begin[seg]
            ok = at <= m[seg]
            seg, at = seg[ok], at[ok]
            if len(seg):
                new = np.ones(len(seg), bool)
                new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
                lo = np.flatnonzero(new)
                more = np.append(lo[1:], len(seg)) - lo - 1
                out.append((u[seg[lo]], (s[seg[lo]] + at[lo]).astype("<i4"), more.astype("<i4")))
            cols = [np.concatenate(c).astype(t) for c, t in zip(zip(*out, strict=True), ("<i8", "<i4", "<i4"), strict=True)]
            yield blobs.rows([(b, 0, blobs.pack(*c)) for b, c in blobs.split(bucket_of(cols[0], n_docs), *cols)])

    return blobs.dealt(segs, partitions).mapInArrow(run, blobs.SCHEMA)


RESULT = "_uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(found: DataFrame, texts: DataFrame, length: int, partitions: int, keep_text: bool) -> DataFrame:
    """Each document without its repeats."""

    def run(batches):
        for _, some in blobs.grouped(batches):
            held, cols = [], None
            for kind, v in some:
                if kind == 0:
                    held.append(blobs.unpack(v, "<i8", "<i4", "<i4"))
                    continue
                if cols is None:
                    held.append([np.zeros(0, "<i8"), np.zeros(0, "<i4"), np.zeros(0, "<i4")])
                    cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                    order = np.lexsort((cols[1], cols[0]))
                    cols = [c[order] for c in cols]
                out = []
                for u, body in read_texts(v):
                    lo, hi = np.searchsorted(cols[0], [u, u + 1])
                    kept, at, n, spans, end = [], 0, 0, 0, -1
                    for a, more in zip(cols[1][lo:hi].tolist(), cols[2][lo:hi].tolist(), strict=True):
                        b = a + more + length
                        if a > end or not spans:
                            spans += 1
                            kept.append(body[at:a])
                            n += b - a
                        else:
                            n += max(0, b - at)
                        at = max(at, b)
                        end = max(end, b)
                    rest = b"".join([*kept, body[at:]])
                    row = (u, len(body), n, spans, hashlib.sha256(rest).hexdigest())
                    out.append((*row, rest) if keep_text else row)
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
                names = ["_uid", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
                c = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names)

    return blobs.dealt(found.unionByName(texts), partitions).mapInArrow(run, RESULT + (", kept binary" if keep_text else ""))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, inner: int = INNER, hot: int = HOT, budget: int = BUDGET, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also the remaining bytes."""
    t, same = with_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", ["text"])
    size = min(input_bytes(t), 1 << 50)
    parts = partitions_for(t)
    n_anchor, n_docs = max(16, size // ANCHOR_BYTES), max(16, size // TEXT_BYTES)
    if size == 1 << 50:  # unknown
        n_anchor = n_docs = 16 * parts
    entries = repeated_anchors(t, length, inner, n_anchor, n_docs, parts, hot)
    texts = texts_by_bucket(t, n_docs, 1)
    segs = segments(entries, texts, length, n_docs, n_docs, parts)
    found = shard_repeats(segs, length, n_docs, n_docs, parts, budget)
    result = removed(found, texts, length, parts, keep_text)
    if same:
        return result.withColumn("doc_id", F.col("_uid")).select("doc_id", *result.columns[1:], "_uid")
    return result.join(t.select("_uid", "doc_id"), "_uid").select("doc_id", *result.columns[1:], "_uid")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
