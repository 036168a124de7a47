"""The join against brute force over all pairs."""

import random

import pytest
from tessera.llm import jaccard


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    """rows: (row, doc_id, text). Class id and links of each row."""
    sets = [grams(t) for _, _, t in rows]
    n, up = len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * u - 1e-12:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)], links


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "ñ"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 40, 120, 300]))))
    return out


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 7)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus(seed)
    rows = [(i, i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "x") for _, d, t in rows], "doc_id long, text string, cluster string")
    root, links = brute(rows)
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs).collect()}
    for i, d, _ in rows:
        assert (got[d].class_id, got[d].n_links) == (root[i] * 3, links[i])


def test_odd_rows(spark):
    same = "one two three four five six"
    docs = spark.createDataFrame([(7, same), (7, same), (None, same), (3, None), (4, ""), (5, "  \n"), (6, "a b"), (2, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect())
    assert got == [(2, 2, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 2, 1), (7, 7, 2), (7, 7, 2), (99, 7, 2)]
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_large_bands_and_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BAND_BLOCK", 5)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4_000)
    texts = corpus(3, 120) + ["the same words in every one of them here"] * 200
    rows = [(i, i, t) for i, t in enumerate(texts)]
    root, links = brute(rows)
    got = {r.doc_id: r for r in jaccard.jaccard_join(spark.createDataFrame([r[1:] for r in rows], "doc_id long, text string")).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(len(rows))] == list(zip(root, links, strict=True))


def test_a_template_does_not_join_texts_into_one_group(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(2_000)]
    template = [rng.choice(words) for _ in range(60)]
    texts = [" ".join(template + [rng.choice(words) for _ in range(60)]) for _ in range(150)]  # 0.3 alike
    docs = spark.createDataFrame(list(enumerate(texts)), "_uid long, text string")
    bands, rows = jaccard.bands_for()
    sig = jaccard.signatures(docs, 5, bands, rows).withColumnRenamed("_uid", "node")
    shared = [set(r.bands) for r in sig.collect()]
    assert sum(bool(a & b) for a, b in zip(shared, shared[1:], strict=False)) > 15
    assert jaccard.candidate_groups(sig, rows, jaccard.least_agreement(bands * rows, 0.8, jaccard.RECALL)).count() == 0


def test_recall_of_bands_and_sketches():
    bands, rows = jaccard.bands_for()
    least = jaccard.least_agreement(bands * rows, 0.8, jaccard.RECALL)
    rng, found, n = random.Random(1), 0, 2_000
    import numpy as np

    for _ in range(n):  # 80 of 100 in common
        common, own = (np.array([rng.getrandbits(64) for _ in range(k)], np.uint64) for k in (80, 20))
        s = jaccard.band_hashes([np.concatenate([common, own[:10]]), np.concatenate([common, own[10:]])], bands, rows)
        same = s[0] == s[1]
        found += bool(same.reshape(bands, rows).all(1).any()) and same.sum() >= least
    assert found == n


def test_first_of_classes_keeps_columns_of_any_name(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    data = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 7, "y"), (None, None, 1, "z"), (3, "", 2, None), (3, "", 2, None), (4, long, 3, "l"), (5, long + " end", 3, "l")]
    docs = spark.createDataFrame(data, "doc_id long, text string, _uid int, `a.b` string")
    got = jaccard.first_of_classes(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((data[k] for k in (0, 2, 3, 4, 5)), key=str)
    assert jaccard.first_of_classes(docs.limit(0)).count() == 0
