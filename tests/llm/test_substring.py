"""Substring dedup against brute force over all windows."""

import hashlib
import random

import pytest
from tessera.llm import substring


def brute(texts, length=100):
    """texts in order of id."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "éau", "x", "\n", "longerword", "\0", "😀"] + [f"w{k}" for k in range(60)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    common, out = [make(30) for _ in range(4)] + ["a" * 300, "ab" * 200, make(60)], []
    for _ in range(n):
        parts = [make(rng.randrange(40)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(common))
        if out and rng.random() < 0.2:
            t = rng.choice(out) or ""
            k = rng.randrange(len(t) + 1)
            parts.append(t[k : k + rng.randrange(400)])
        out.append("".join(parts))
    return [*out, None, "", out[0], out[1]]


@pytest.mark.parametrize("seed,hot,chunk,budget", [(1, 1024, 16, 1 << 20), (2, 3, 2, 500), (3, 1024, 3, 1 << 20)])
def test_against_brute_force(spark, seed, hot, chunk, budget, monkeypatch):
    monkeypatch.setattr(substring, "HOT_CHUNK", chunk)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bucket string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.dedup_substrings(docs, hot=hot, budget=budget).collect()}
    want = brute(texts)
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i], w)


def test_odd_rows(spark):
    t = "some text that is over one hundred bytes long, as a sentence with many many words can easily be, I think so."
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (-9, "b" + t), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed) for r in substring.dedup_substrings(docs).collect())
    n = len(t)
    assert got == [((False, -9), 0), ((False, 4), n), ((False, 4), n), ((False, 7), 0), ((True, 0), n)]
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_long_texts_are_cut_in_pieces_without_loss():
    import numpy as np

    a = substring.Anchors()
    t = "".join(random.Random(3).choice("abcd ") for _ in range(3000)).encode()
    whole = a([t])
    a.pieces = lambda texts, most=500: substring.Anchors.pieces(a, texts, most)
    cut = a([t])
    spread = lambda r: sorted((int(s) + k, int(s) + int(p), int(h)) for s, m, p, h in zip(r[1], r[2], r[3], r[4], strict=True) for k in range(int(m) + 1))
    assert spread(whole) == spread(cut) and np.all(whole[2] <= 50)
