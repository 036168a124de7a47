"""Forward-backward against enumeration, and accuracy on held-out labels."""

import itertools

import numpy as np
from tessera.llm import quality


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 5, 2])
    score, move = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    p, pair, logz = quality.Chains(lines).marginals(score, move)
    at, pairs, total = 0, np.zeros((2, 2)), 0.0
    for n in lines:
        z, good = 0.0, np.zeros(n)
        moves = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + k] for k in range(n) if y[k]) + sum(move[a, b] for a, b in itertools.pairwise(y)))
            z += w
            good += w * np.array(y)
            for a, b in itertools.pairwise(y):
                moves[a, b] += w
        assert np.allclose(p[at : at + n], good / z)
        pairs += moves / z
        total += np.log(z)
        at += n
    assert np.allclose(pair, pairs) and np.isclose(logz, total)


def test_features_do_not_depend_on_the_batch():
    texts = [b"One two two. Three!", b"", b"A\nB B B\n\n### $$ 12", "é ü".encode()]
    x, length, lines = quality.line_features(texts)
    parts = [quality.line_features([t]) for t in texts]
    assert np.allclose(x, np.concatenate([p[0] for p in parts])) and lines.tolist() == [1, 1, 4, 1]
    assert length.tolist() == [len(line) for t in texts for line in t.split(b"\n")]


def test_a_batch_scores_like_its_single_texts():
    texts = [b"Same line here.", b"Same line here.", b"x\nSame line here.", b"Same line here.\nSame line here.", b"", b"Other words."] * 3
    x, length, lines = quality.line_features(texts)
    assert np.array_equal(x, np.concatenate([quality.line_features([t])[0] for t in texts]))
    rng = np.random.default_rng(1)
    model = quality.fit(x, length, lines, rng.integers(0, 2, len(texts)), steps=20)
    assert np.allclose(model.scores(texts), np.concatenate([model.scores([t]) for t in texts]), atol=1e-6)


def test_held_out_accuracy(spark):
    got = quality.op2_crf_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert ((held.score >= 0.3) == held.quality).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "abc def. " * 20_000, "z"), (2, "", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert quality.classify(docs.limit(0), None).count() == 0


def test_columns_of_any_name_and_long_texts(spark):
    rows = [(k, ("Good words stand here. " if k % 2 else "@@## $$ 12 ") * 4 + f"{k}", k, k, k, f"x{k}") for k in range(60)] + [(None, None, 1, 1, 1, None), (61, "\n" * 200_000, 1, 1, 1, "n"), (62, "word " * 400_000, 2, 2, 2, "l"), (62, "word " * 400_000, 2, 2, 2, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted int, _text int, `a.b` string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(63)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.classify(docs, model, keep=docs.columns)
    assert got.columns == [*docs.columns, "score_", "predicted_"]
    by = {}
    for r in got.collect():
        by.setdefault(tuple(r)[:1] + tuple(r)[2:6], []).append((r.score_, r.predicted_))
    assert sum(map(len, by.values())) == len(rows) and len(set(by[(62, 2, 2, 2, "l")])) == 1 and len(by[(62, 2, 2, 2, "l")]) == 2
    assert quality.classify(docs.limit(0), model, keep=docs.columns).count() == 0


def test_scores_against_a_plain_version(spark):
    """The query's scores: each text by itself, with forward-backward in plain loops."""
    import math

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.op2_crf_quality(spark, sf).collect()}
    assert len(got) == len(texts)
    for doc, text in texts.items():
        x, length, _ = quality.line_features([(text or "").encode()])
        z, d = (x.astype(float) - m.mean) / m.std, x.shape[1]
        unary = []
        for i in range(len(z)):
            u = m.w[3 * d] + sum(z[i][k] * m.w[k] for k in range(d))
            u += sum(z[i - 1][k] * m.w[d + k] for k in range(d)) if i else 0
            u += sum(z[i + 1][k] * m.w[2 * d + k] for k in range(d)) if i + 1 < len(z) else 0
            unary.append(u)
        e = lambda i, y: math.exp(unary[i] * y / 1)
        f, b = [[e(0, 0), e(0, 1)]], [[1.0, 1.0]]
        for i in range(1, len(z)):
            new = [sum(f[-1][p] * math.exp(m.move[p][y]) for p in (0, 1)) * e(i, y) for y in (0, 1)]
            f.append([v / sum(new) for v in new])
        for i in range(len(z) - 1, 0, -1):
            new = [sum(math.exp(m.move[p][y]) * e(i, y) * b[0][y] for y in (0, 1)) for p in (0, 1)]
            b.insert(0, [v / sum(new) for v in new])
        good = [f[i][1] * b[i][1] / (f[i][0] * b[i][0] + f[i][1] * b[i][1]) for i in range(len(z))]
        weight = [max(1, int(n)) for n in length]
        q = min(max(sum(g * n for g, n in zip(good, weight, strict=True)) / sum(weight), 1e-9), 1 - 1e-9)
        want = 1 / (1 + math.exp(-(m.curve[0] * math.log(q / (1 - q)) + m.curve[1])))
        assert abs(got[doc] - want) < 1e-4
