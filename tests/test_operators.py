"""Operators that SQL cannot check: known answers, invariants and recovery of planted states."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera.operators import changepoint, metrics, pit, splits, states
from tessera.operators.models import hmm, other
from tessera.sources import ingest, schemas, store, synthetic
from tessera.streaming import online


def frame(spark, xs, key="a"):
    return spark.createDataFrame([(key, i, None if x is None else float(x)) for i, x in enumerate(xs)], "asset string, t long, value double")


def accuracy(got, truth):
    pairs = pd.crosstab(pd.Series(got, name="g"), pd.Series(truth, name="t")).to_numpy()
    n = max(pairs.shape)
    cost = np.zeros((n, n))
    cost[: pairs.shape[0], : pairs.shape[1]] = -pairs
    return -sum(cost[i, j] for i, j in enumerate(states.hungarian(cost))) / len(got)


@pytest.mark.parametrize("method", ["cusum", "page_hinkley", "binary_segmentation", "pelt", "distributional", "bocpd"])
def test_detectors_find_a_jump(method):
    x = np.concatenate([np.random.default_rng(1).normal(size=100), 6 + np.random.default_rng(2).normal(size=100)])
    how = {"threshold": 20.0} if method == "page_hinkley" else {"most": 1} if method == "binary_segmentation" else {"threshold": 8.0, "drift": 0.5, "least": 20} if method == "cusum" else {"short": 3} if method == "bocpd" else {}
    _, cuts = changepoint.DETECTORS[method](x, **how)
    assert any(95 <= c <= 110 for c in cuts)


def _series(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(12, 260))
    return np.repeat(rng.normal(0, 3, n // 8 + 1), 8)[:n] + rng.normal(size=n) * rng.choice([0.05, 1.0])


@pytest.mark.parametrize("seed", range(30))
def test_online_detectors_row_by_row(seed):
    x, least, limit = _series(seed), 5, 4.0
    # one row at a time, as the recurrences are written
    mean, std, up, down, want, cuts = x[:least].mean(), x[:least].std(ddof=1) or 1.0, 0.0, 0.0, [], []
    for i, v in enumerate(x):
        z = (v - mean) / std
        up, down = max(0.0, up + z - 0.2), max(0.0, down - z - 0.2)
        want.append(max(up, down))
        if i >= least and want[-1] >= limit:
            cuts, up, down, mean = [*cuts, i], 0.0, 0.0, v
    scores, got = changepoint.cusum(x, limit, 0.2, least)
    assert got == cuts and np.allclose(scores, want)
    mean = total = low = 0.0
    want, cuts = [], []
    for i, v in enumerate(x):
        mean += (v - mean) / (i + 1)
        total = 0.99 * total + v - mean - 0.005
        low = min(low, total)
        want.append(total - low)
        if i >= least and want[-1] >= limit:
            cuts, total, low, mean = [*cuts, i], 0.0, 0.0, v
    scores, got = changepoint.page_hinkley(x, limit, 0.005, 0.99, least)
    assert got == cuts and np.allclose(scores, want)


def test_a_constant_baseline_has_deviation_one():
    x = np.concatenate([np.full(30, 2.0), 2 + np.random.default_rng(0).normal(0, 0.1, 30)])
    scores, cuts = changepoint.cusum(x, least=30)
    assert not cuts and scores.max() < 2


def test_shifted_series():
    """30 rows of 0, 35 of 5, 30 of -2: the boundaries are 30 and 65."""
    x = np.concatenate([np.zeros(30), np.full(35, 5.0), np.full(30, -2.0)])
    assert changepoint.optimal_partition(x)[1] == [30, 65]
    assert {30, 65} <= set(changepoint.binary_segmentation(x)[1])
    assert any(abs(c - 30) <= 5 for c in changepoint.cusum(x)[1]) and {30, 65} <= set(changepoint.distributional(x, 10, 0.5)[1])
    metrics_ = changepoint.boundary_metrics([31, 65, 80], [30, 65], 95)
    assert metrics_["delay"] == 0.5 and metrics_["false_alarms"] == pytest.approx(1 / 95)


@pytest.mark.parametrize("short", [0, 3])
def test_bayesian_online_keeps_every_run_length(short):
    import math

    x = np.random.default_rng(9).normal(size=500)
    hazard, want, prior = 0.01, [], (0.0, 1.0, 1.0, 1.0)
    logp, runs = np.zeros(1), [prior]
    for v in x:
        like = []
        for m, k, a, b in runs:
            s2, df = b * (k + 1) / (a * k), 2 * a
            like.append(math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(df * math.pi * s2) - (a + 0.5) * math.log1p((v - m) ** 2 / (df * s2)))
        w = logp + like
        logp = np.concatenate([[np.logaddexp.reduce(w) + math.log(hazard)], w + math.log(1 - hazard)])
        logp -= np.logaddexp.reduce(logp)
        runs = [prior] + [((k * m + v) / (k + 1), k + 1, a + 0.5, b + k * (v - m) ** 2 / (2 * (k + 1))) for m, k, a, b in runs]
        want.append(np.exp(logp[: short + 1]).sum())
    assert np.allclose(changepoint.bayesian_online(x, short=short)[0], want, rtol=0, atol=1e-9)


def _plain_cost(x, a, b):
    return float(((x[a:b] - x[a:b].mean(0)) ** 2).sum())


@pytest.mark.parametrize("seed", range(60))
def test_partition_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, pen, least = int(rng.integers(8, 70)), float(rng.choice([0.3, 1.0, 3.0])), int(rng.integers(2, 6))
    x = np.repeat(rng.normal(0, 2, n), rng.integers(1, 9))[:n] + rng.normal(size=n) * 0.5
    if seed % 3 == 0:
        x = np.stack([x, rng.normal(size=n)], 1)
    best = [-pen] + [np.inf] * n
    for t in range(least, n + 1):
        best[t] = min(best[a] + _plain_cost(x, a, t) + pen for a in [0, *range(least, t - least + 1)] if t - a >= least)
    cuts = changepoint.optimal_partition(x, pen, least)[1]
    ends = [0, *cuts, n]
    assert sum(_plain_cost(x, a, b) + pen for a, b in zip(ends, ends[1:], strict=False)) - pen == pytest.approx(best[n])


@pytest.mark.parametrize("seed", range(10))
def test_segmentation_and_kernel_scan_against_plain_loops(seed):
    x, least = _series(seed)[:90], 5
    segments, cuts, scores = [(0, len(x))], [], np.zeros(len(x))
    for _ in range(4):
        best = (0.0, None, None)
        for a, b in segments:
            for k in range(a + least, b - least + 1) if b - a >= 2 * least else ():
                g = _plain_cost(x, a, b) - _plain_cost(x, a, k) - _plain_cost(x, k, b)
                scores[k] = max(scores[k], g)
                best = (g, k, (a, b)) if g > best[0] + 1e-9 else best
        if best[1] is None or best[0] < 1.0:
            break
        cuts.append(best[1])
        segments.remove(best[2])
        segments += [(best[2][0], best[1]), (best[1], best[2][1])]
    got = changepoint.binary_segmentation(x, 4, least)
    assert got[1] == sorted(cuts) and np.allclose(got[0], scores, atol=1e-8)
    w, want = 8, np.zeros(len(x))
    k = lambda a, b: np.mean([[np.exp(-(p - q) ** 2 / max(x.var(), 1e-6)) for p in a] for q in b])
    for i in range(w, len(x) - w):
        a, b = x[i - w : i], x[i : i + w]
        want[i] = max(0.0, k(a, a) + k(b, b) - 2 * k(a, b)) ** 0.5
    assert np.allclose(changepoint.distributional(x, w)[0], want, atol=1e-7)


def test_hmm_recovers_states_and_filters_online():
    rng = np.random.default_rng(0)
    s = synthetic._chain(rng, 600, 2, 0.95)
    x = (np.where(s == 1, 2.0, -2.0) + rng.normal(size=600))[:, None]
    p = hmm.fit(x, hmm.Config(states=2))
    f, _ = hmm.forward(hmm.emissions(x, p), p)
    assert accuracy(f.argmax(1), s) > 0.95
    o = hmm.OnlineFilter(p)
    assert np.allclose([o.step(r) for r in x[:50]], f[:50])
    logs = [np.log(p.start)]
    brute = hmm.smooth(hmm.emissions(x[:4], p), p)[3]
    e, total = hmm.emissions(x[:4], p), 0.0
    import itertools

    for path in itertools.product((0, 1), repeat=4):
        total += np.exp(logs[0][path[0]] + sum(e[t, k] for t, k in enumerate(path)) + sum(np.log(p.moves[a, b]) for a, b in itertools.pairwise(path)))
    assert brute == pytest.approx(np.log(total))


def test_hmm_queries_run_to_the_operators_own_limits(monkeypatch):
    from tessera.plans import model_queries

    seen = []
    monkeypatch.setattr(model_queries, "_small", lambda s, d: None)
    monkeypatch.setattr(hmm, "run_series", lambda df, features, c: seen.append(c))
    for name in hmm.VARIANTS:
        model_queries._hmm(name)(None, None)
    assert [(c.iterations, c.restarts) for c in seen] == [(c.iterations, c.restarts) for c in hmm.VARIANTS.values()]


def test_jump_and_switching_models():
    rng = np.random.default_rng(4)
    s = np.repeat([0, 1, 0, 1], 60)
    x = (np.where(s == 1, 3.0, -3.0) + rng.normal(size=240))[:, None]
    assert accuracy(other.jump_segmentation(x, 2, 5.0), s) > 0.98
    assert accuracy(other.switching_lds(x).argmax(1), s) > 0.9
    assert accuracy(other.hierarchical(x, 2), s) > 0.98
    cost = rng.random((7, 2))
    import itertools

    best = min(itertools.product((0, 1), repeat=7), key=lambda p: sum(cost[t, k] for t, k in enumerate(p)) + 0.4 * sum(a != b for a, b in itertools.pairwise(p)))
    assert tuple(other.jump_path(cost, 0.4)) == best


def test_assignment_is_least():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(50):
        c = rng.integers(0, 20, (4, 5)).astype(float)
        got = sum(c[i, j] for i, j in enumerate(states.hungarian(c)))
        assert got == min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(5), 4))


def test_splits_never_leak():
    for s in splits.purged(50, 10, 20, 15, embargo=2).split(200):
        held = set(range(*s.validation)) | set(range(*s.test))
        blocked = {i for a, b in s.blocked(200) for i in range(a, b)}
        assert not (set(range(*s.train)) - blocked) & held and s.test[1] <= 200
    inner = splits.nested(next(splits.ExpandingWindow(50, 10, 20).split(200)), splits.ExpandingWindow(10, 5, 5))
    assert all(s.test[1] <= 50 for s in inner)


def test_walk_forward_takes_every_series(spark):
    from tessera.operators import evaluation

    rng, plan = np.random.default_rng(8), splits.purged(40, 10, 15, embargo=2)
    rows = [(a, t, float(x)) for a, n in (("a", 90), ("b", 120), ("c", 30)) for t, x in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "asset string, t long, x double")
    got = {(r.asset, r.split, r.t, r.role) for r in evaluation.walk_forward(df, ["x"], plan.split).collect()}
    want = set()
    for a, n in (("a", 90), ("b", 120), ("c", 30)):
        at = splits.assign(splits.with_positions(df.filter(F.col("asset") == a)), list(plan.split(n)), n) if n > 65 else None
        want |= {(a, r.split, r.t, r.role) for r in at.collect() if r.role != "train"} if at else set()
        assert all([s.roles(n)[r.t] for s in [list(plan.split(n))[r.split]]] == [r.role] for r in at.collect()) if at else True
    assert got == want and {k[0] for k in got} == {"a", "b"}


def test_walk_forward_query_covers_all_series(spark):
    from tessera.plans import catalog
    from tessera.plans import inputs as I

    sf = "/root/testdata/sf0.001"
    got = {r.asset for r in catalog.queries()["eval_walk_forward"](spark, sf).select("asset").distinct().collect()}
    assert got == {r.asset for r in I.bars(spark, sf).select("asset").distinct().collect()}


def test_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    mk = lambda n: [("a", int(s), int(s + w)) for s, w in zip(rng.integers(0, 900, n), rng.integers(0, 150, n), strict=True)]
    a, b = mk(60), mk(15)
    got = {tuple(r) for r in pit.overlapping(spark.createDataFrame(a, "k string, s long, e long"), spark.createDataFrame(b, "k string, s long, e long"), ["k"]).collect()}
    assert got == {x for x in a if x[1] < x[2] and any(x[1] < y[2] and x[2] > y[1] and y[1] < y[2] for y in b)}


def test_bootstrap_and_confidence_set(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=300) ** 2
    rows = [(float(b), float(b * 0.5), float(b + 0.1)) for b in base]
    df = spark.createDataFrame(rows, "bench double, good double, bad double")
    got = metrics.bootstrap_tests(df, ["good", "bad"], "bench", 200)
    assert got["reality_check_p"] < 0.05 and got["spa_p"] < 0.05
    assert metrics.model_confidence_set(df, ["bench", "good", "bad"], n_bootstrap=200) == ["good"]
    i = metrics.bootstrap_indices(50, 5, 1)
    assert len(i) == 50 and i.min() >= 0 and i.max() < 50


def test_feature_builder(spark):
    df = spark.createDataFrame([("a", i, i + 1, float(i)) for i in range(10)], "asset string, ts long, publication_ts long, x double")
    reg = pit.FeatureRegistry()
    d = pit.FeatureDefinition("double", "1", lambda f: f["raw"].withColumn("y", F.col("x") * 2), ("raw",), outputs=("y",), scaling="standard")
    reg.register(d)
    got = pit.FeatureBuilder(reg).build("double", {"raw": df}, as_of=F.lit(8), training=F.col("ts") <= 3).orderBy("ts").collect()
    assert [r.ts for r in got] == list(range(8)) and got[0].y == pytest.approx(-1.3416407)
    with pytest.raises(ValueError):
        reg.register(pit.FeatureDefinition("double", "1", None))
    bad = df.withColumn("publication_ts", F.col("ts") - 1)
    with pytest.raises(Exception, match="dated after"):
        pit.available_inputs(bad, F.lit(9)).collect()


def test_store(spark, tmp_path):
    from pyspark.sql import Row

    s = store.Store(spark, str(tmp_path))
    st = schemas.schema("fx")
    row = {f.name: None for f in st.fields} | {"base_currency": "EUR", "quote_currency": "USD", "mid": 1.1, "event_ts": dt.datetime(2024, 1, 1), "source_id": "x", "ingested_at": dt.datetime(2024, 1, 2), "data_quality_flags": "[]"}
    df = spark.createDataFrame([Row(**row)], st)
    part = store.Partition("fx", "x", "fx", "2024-01-01", "v1")
    first = s.write(df, "fx", part)
    assert s.write(df, "fx", part)["fingerprint"] == first["fingerprint"]
    with pytest.raises(FileExistsError):
        s.write(df.withColumn("mid", F.lit(2.0)), "fx", part)
    assert s.scan("fx", ["mid"]).first().mid == 1.1 and s.scan("fx", ["mid"], part).count() == 1
    assert s.query("SELECT sum(mid) AS m FROM v", v=s.scan("fx")).first().m == 1.1
    with pytest.raises(ValueError):
        schemas.validate(df.drop("mid"), "fx")
    assert schemas.problems(spark.createDataFrame([("future",)], "option_type string"), schemas.project(schemas.schema("option_quotes"), ["option_type"]))["values"] == [("option_type", ["future"])]


def test_paged_source(spark):
    spark.dataSource.register(ingest.PagedSource)
    df = spark.read.format("tessera_pages").option("symbols", "aa,bb").option("fetch", "tessera.sources.ingest:mock_fetch").load()
    assert df.count() == 24 and df.select("symbol").distinct().count() == 2
    assert ingest.first_accessible(lambda d: d >= dt.date(2020, 5, 17), dt.date(2019, 1, 1), dt.date(2024, 1, 1)) == dt.date(2020, 5, 17)


def stream(spark, df, make, tmp_path, parts=3):
    """The rows in several micro-batches."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = df.orderBy("t").collect()
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], df.schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(s).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(out).orderBy("t").toPandas()


def test_online_equals_batch(spark, tmp_path):
    x = np.concatenate([np.random.default_rng(1).normal(size=40), 5 + np.random.default_rng(2).normal(size=40)])
    df = frame(spark, x)
    scores, cuts = changepoint.cusum(x)
    got = stream(spark, df, lambda s: online.cusum(s), tmp_path / "a")
    assert cuts and got.t[got.alarm].tolist() == cuts and np.allclose(got.score[5:], scores[5:])
    scores, cuts = changepoint.page_hinkley(x, 20.0)
    got = stream(spark, df, lambda s: online.page_hinkley(s, 20.0), tmp_path / "b")
    assert got.t[got.alarm].tolist() == cuts and np.allclose(got.score, scores)
    p = hmm.fit(x[:, None], hmm.Config(states=2))
    got = stream(spark, df, lambda s: online.hmm_filter(s, p), tmp_path / "c")
    assert np.allclose(np.array(got.probabilities.tolist()), hmm.forward(hmm.emissions(x[:, None], p), p)[0])
    from tessera.operators.rules import HysteresisRule

    want = HysteresisRule("value", 3, 0).predict(df).orderBy("t").toPandas().state.tolist()
    assert stream(spark, df, lambda s: online.hysteresis(s, 3, 0), tmp_path / "d").state.tolist() == want


def test_generators_do_not_depend_on_partitions(spark):
    a = synthetic.generate(spark, "gaussian_hmm", 3, 50).orderBy("asset", "t").toPandas()
    b = synthetic.generate(spark.newSession(), "gaussian_hmm", 3, 50).orderBy("asset", "t").toPandas()
    assert a.equals(b) and len(a) == 150


def test_turnover_control_moves_at_most_so_far(spark):
    from tessera.operators import backtest

    r = spark.createDataFrame([(t, a, 0.01 * ((t * 7 + len(a)) % 5 - 2)) for t in range(12) for a in ("x", "yy")], "t long, asset string, ret double")
    w, by = backtest.equity_backtest(r, cfg=backtest.EquityConfig(max_turnover=0.2))
    got = w.groupBy("t").pivot("asset").agg(F.first("w")).orderBy("t").toPandas().drop(columns="t").to_numpy()
    assert (np.abs(np.diff(got, axis=0)).sum(1) <= 0.2 + 1e-9).all() and by.count() == 12


def test_registry_and_stages(tmp_path):
    from tessera import experiments as ex

    reg = ex.Registry(tmp_path)
    run = reg.start("m", {"api_key": "x", "k": 1})
    assert reg.start("m", {"api_key": "x", "k": 1}).id == run.id and "x" not in reg.runs()[0]["config"].replace("api_key", "")
    calls = []
    stages = [ex.Stage("a", lambda d: calls.append("a") or 1), ex.Stage("b", lambda d: calls.append("b") or d["a"] + 1, {"v": 1})]
    assert ex.run_stages(run, stages)["b"] == 2 and ex.run_stages(run, stages)["b"] == 2 and calls == ["a", "b"]
    run.log_metrics({"loss": 0.5})
    run.log_json("summary", {"a": None, "b": 1})
    run.finish()
    assert reg.compare("default", "loss")["ranked"] == [("m", 0.5)] and len(reg.artifacts(run.id, "summary")) == 1
    assert ex.optimize(ex.SearchSpace({"x": (0.0, 1.0)}), lambda p: (p["x"] - 0.3) ** 2, 50)["value"] < 0.01
    assert ex.Report("t").table("x", [{"a": 1}]).line("y", [1.0, 2.0]).write(tmp_path / "r.html").exists()


def test_the_normal_distribution_has_double_precision(spark):
    from tessera.functions.exprs import normal_cdf

    xs = [k / 8 for k in range(-304, 305)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    for x, g in zip(xs, got, strict=True):
        assert g == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-8, abs=1e-300)
    # tabulated
    at = dict(zip(xs, got, strict=True))
    assert at[1.0] == pytest.approx(0.8413447460685429, abs=1e-15) and at[-2.0] == pytest.approx(0.022750131948179195, abs=1e-15) and at[0.0] == 0.5


def test_quotes_and_bounds(spark):
    from tessera.operators import pricing

    lit = {"bid": F.lit(4.0), "ask": F.lit(3.5), "bid_size": F.lit(0.0), "ask_size": F.lit(0.0), "volume": F.lit(0.0), "open_interest": F.lit(0.0)}
    got = spark.range(1).select(pricing.quote_reasons(lit, F.lit(3600.0), min_volume=1, min_interest=1)).first()[0]
    assert got == ["crossed_market", "stale_quote", "low_bid_size", "low_ask_size", "low_volume", "low_open_interest"]
    a = [F.lit(x) for x in (100.0, 100.0, 0.5, 0.03, 0.01)]
    price = spark.range(1).select(pricing.black_scholes(F.lit("call"), *a, F.lit(0.2)).alias("p"))
    p = price.first().p
    r = price.select(pricing.no_arbitrage(F.lit("call"), F.lit(-1.0), *a).alias("low"), pricing.no_arbitrage(F.lit("call"), F.lit(101.0), *a).alias("high"), pricing.no_arbitrage(F.lit("call"), F.col("p"), *a).alias("ok"), pricing.greeks(F.lit("call"), *a, F.lit(0.2)).alias("g")).first()
    assert r.low.reasons == ["below_lower_bound"] and r.high.reasons == ["above_upper_bound"] and r.ok.valid and 0 < r.g.delta < 1 and r.g.vega > 0
    iv = spark.createDataFrame([(p, "call", 100.0, 100.0, 0.5, 0.03, 0.01)], "p double, o string, s double, k double, t double, r double, q double").select(pricing.implied_volatility("p", "o", "s", "k", "t", "r", "q")).first()[0]
    assert iv == pytest.approx(0.2, abs=1e-6)
