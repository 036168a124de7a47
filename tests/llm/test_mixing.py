"""Mixing against a plain water-filling loop, and the limits on every document."""

import math
import re

import pytest
from tessera.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows(n):
    out = []
    for i in range(n):
        s = None if i % 17 == 0 else f"src{(i * i) % 7}" if i % 3 else "hot"
        words = 1 + (i * 7919) % (40 if i % 50 else 900)
        out.append((i, " ".join(["w"] * words) + "\n" * (i % 2), s, "x"))
    return [*out, (n, None, "src0", "x"), (n + 1, "  \t", None, "x"), (n + 2, "a b c", "src1", "x"), (5, "again", "src1", "x"), (5, "again", "src1", "x"), (None, "null id", "src2", "x")]


@pytest.mark.parametrize("groups", [5_000, 37])
def test_mix(spark, groups, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", groups)
    data = rows(2_000)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = plain_targets(sizes), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.001 * t)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((r.doc_id or -1, r.size, r.taken) for r in rs)
    assert key(got) == key(again)


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(docs).collect()] == [0, 0]


def plain_rates(sizes, target, cap=2):
    """Bisection on the multiplier of one source."""
    words, mean = sum(sizes), sum(sizes) / len(sizes)
    if target >= cap * words * (1 - 1e-12):
        return {z: float(cap) if z else 0.0 for z in sizes}
    rate = lambda m, z: cap / (1 + (cap - 1) * math.exp(min(700.0, -m * z / mean))) if z else 0.0
    lo, hi = -1e4, 1e4
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(z * rate(mid, z) for z in sizes) < target else (lo, mid)
    return {z: rate(lo, z) for z in sizes}


def test_rates_and_copies_against_a_plain_version(spark):
    data = rows(1_500)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for rs in by_source.values():
        want = plain_rates([r.size for r in rs], rs[0].target)
        n, copies = {}, {}
        for r in rs:
            assert r.rate == pytest.approx(want[r.size], abs=2e-5)
            assert abs(r.copies - r.rate) <= 2 and r.taken == r.copies * r.size
            n[r.size], copies[r.size] = n.get(r.size, 0) + 1, copies.get(r.size, 0) + r.copies
        # a size's copies are its rate's, but for rounding and the few sizes that were moved
        off = [z for z in n if abs(copies[z] - n[z] * want[z]) > 1.001]
        assert len(off) <= 3


def test_columns_of_any_name_repeats_and_long_texts(spark):
    long = "w " * 300_000
    data = [(1, "a b c", "s", 7, 8, "x"), (1, "a b c", "s", 7, 8, "x"), (None, long, None, 7, 8, None), (2, None, "s", None, 8, "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _uid int, _copy int, `a.b` string").withColumnRenamed("_copy", "_copies")
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    rows_ = got.collect()
    assert {tuple(r) for r in rows_} <= set(data) and (None, long, None, 7, 8, None) in {tuple(r) for r in rows_}
    assert mixing.repeated(docs.limit(0)).count() == 0
