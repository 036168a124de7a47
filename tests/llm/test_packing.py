"""Packing against a plain count of tokens and the lower bound on sequences."""

import zlib

import numpy as np
import pytest
from tessera.llm import packing


def reference_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


TEXTS = ["", None, "a b c", "a b c", "é" * 40 + " <|endoftext|> x", "word " * 5000, "一二三 ４５   y", "x" * 3000]


def check(rows, ids, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, want in enumerate(ids):
        got = sorted(by_doc[k], key=lambda r: r.piece)
        assert sum(r.length for r in got) == len(want)
        assert all(r.length == capacity for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_pack_whole_texts(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.best_fit_pack(docs).collect()
    ids = reference_ids(TEXTS)
    n = check(rows, ids, 1024)
    assert n <= -(-sum(map(len, ids)) // 1024) + 1


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_pack(docs).count() == 0
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    rows = packing.best_fit_pack(docs).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_a_packing(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.integers(10, 60))
    sizes = rng.integers(1, cap + 1, int(rng.integers(1, 80)))
    counts = dict(zip(*map(lambda x: x.tolist(), np.unique(sizes, return_counts=True))))
    where, used, seen = packing.plan(counts, cap), {}, set()
    for s, n in counts.items():
        rows = where[s]
        for rank in range(n):
            k = np.searchsorted(rows[:, 0], rank, side="right") - 1
            seq = int(rows[k, 1] + rank - rows[k, 0])
            used[seq] = used.get(seq, 0) + s
            assert (seq, int(rows[k, 2])) not in seen
            seen.add((seq, int(rows[k, 2])))
    assert max(used.values()) <= cap
    assert len(used) <= max(1, 11 / 9 * -(-sizes.sum() // cap) + 6 / 9 + sum(s > cap / 2 for s in sizes))


def exact_bins(sizes, cap):
    """The least number of bins, by search."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for left in set(bins):
            if left >= sizes[k]:
                b = list(bins)
                b.remove(left)
                go(k + 1, [*b, left - sizes[k]])
        go(k + 1, [*bins, cap - sizes[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_the_optimum(seed):
    from collections import Counter

    rng = np.random.default_rng(seed)
    cap = int(rng.integers(8, 30))
    sizes = rng.integers(max(1, cap // 4), cap + 1, 8).tolist()
    left = Counter(sizes)
    fixed = packing.dominance_reduction(left, cap)
    assert sum(b.n for b in fixed) + exact_bins(list(left.elements()), cap) == exact_bins(sizes, cap)


def test_both_libraries_agree_over_all_plain_characters():
    """Every character that takes the faster library: alone, between others of each class, and in random runs."""
    import random

    from tokenizers import Tokenizer

    given = packing.public_vocabulary()
    fast, slow = packing.Encoder(**given), Tokenizer.from_file(given["path"])
    plain = [chr(c) for c in range(0x2100) if not packing.PLAIN.search(chr(c))]
    assert len(plain) > 250
    rng = random.Random(11)
    texts = [p.format(c) for c in plain for p in ("{0}", "a{0}b", "1{0}2", " {0} ", "{0}{0}{0}", "\n{0}\r\n", "'{0}", "{0}'s", "-{0} x")]
    texts += ["".join(rng.choice(plain) if rng.random() < 0.5 else rng.choice("abcXYZ 019\n\t'.,") for _ in range(300)) for _ in range(300)]
    for t in texts:
        assert not packing.PLAIN.search(t) or "<|" in t
        if "<|" not in t:
            assert fast(t) == np.asarray(slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
