"""The pipeline, stage by stage, against plain versions on a small table."""

import re
from collections import Counter

import corpus_pipeline as cp
from test_jaccard import brute
from test_mixing import plain_targets
from test_packing import check, reference_ids
from tessera.llm import pii, quality

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(1000)
    columns, given, out = docs.columns, {r.doc_id: r for r in docs.collect()}, []
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
    good, one, clean, mixed, packed = out
    # quality: as the labels have it, nearly
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert all(given[r.doc_id].text == r.text for r in good)
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.97 * len(labels)
    # one of each class
    rows = sorted((r.doc_id, r.text) for r in good)
    root, _ = brute([(i, d, t) for i, (d, t) in enumerate(rows)])
    assert {r.doc_id for r in one} == {rows[i][0] for i in set(root)}
    # personal data
    assert {r.doc_id: r.text for r in clean} == {r.doc_id: pii.redacted(r.text) for r in one}
    assert all(r.n_chars == len(r.text) for r in clean) and not any(pii.base_spans(r.text) for r in clean)
    # mixing
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r.source] += words(r.text)
    for r in mixed:
        taken[r.source] += words(r.text)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t)
    # packing
    ids = reference_ids([r.text for r in mixed])
    assert sum(r.length for r in packed) == sum(map(len, ids))
    seqs = {}
    for r in packed:
        seqs.setdefault(r.sequence_id, []).append(r)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(seqs) <= 1.02 * sum(map(len, ids)) / 1024 + 1


EXTRA = "score double, predicted int, _text string, _uid long, _copies int, sequence_id long, piece int, `a.b` string"


def odd_table(spark):
    """Nulls in every column, empty and very long texts, repeated rows, repeated and null ids, and columns whose names the operators use."""
    prose = lambda k: " ".join(f"Line {k} has words number {k * 7 + j} in it." for j in range(30))
    rest = (0.5, 1, "t", 3, 4, 5, 6, "x")
    rows = [(k, prose(k), "en", f"s{k % 3}", 10, *rest) for k in range(40)]
    rows += [(None, prose(100), None, None, None, *[None] * 8), (41, None, "en", "s0", None, *rest), (42, "", "en", "s1", 0, *rest), (42, "", "en", "s1", 0, *rest), (3, prose(3), "en", "s0", 10, *rest), (44, prose(3) + " mail a@b.cd", "en", None, 1, *rest), (45, " ".join(f"Word{j} runs on." for j in range(60_000)), "en", "s2", 1, *rest), (46, "\n" * 50_000, "en", "s2", 1, *rest)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"), rows


def test_stages_with_odd_rows_and_columns(spark, tmp_path):
    import os

    docs, rows = odd_table(spark)
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert os.path.exists(sf)
    for k, (name, stage) in enumerate(cp.STAGES):
        got = stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            assert got.columns == docs.columns, name
        out, n = got.collect(), docs.count()
        texts = Counter(r.text for r in docs.collect())
        if k == 0:
            assert 0 < len(out) <= n and not Counter(r.text for r in out) - texts
            continue  # the next stages get all odd rows
        if k == 1:  # copies of one text go, null, empty and blank ones stay
            kept = Counter(r.text for r in out)
            assert kept[None] == 1 and kept[""] == 2 and kept["\n" * 50_000] == 1 and max(v for t, v in kept.items() if t) == 1
        if k == 2:
            assert len(out) == n and not any("a@b.cd" in (r.text or "") for r in out) and sum(r.text is None for r in out) == 1
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
        if k == 3:
            assert not any(r.text in (None, "", "\n" * 50_000) for r in out)
        if k == 4:
            assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
        # the other columns are those of the row
        if k in (1, 3):
            assert {tuple(r)[5:] for r in out} <= {tuple(r[5:]) for r in rows}
    assert len(rows) == n


def test_stages_with_an_empty_table(spark, tmp_path):
    docs = odd_table(spark)[0].limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_run_over_odd_rows(spark, tmp_path):
    docs, rows = odd_table(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows}
