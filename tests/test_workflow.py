"""Models by name, evaluation over windows, studies, searches, providers and charts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import charts, experiments, workflow
from tessera.operators import runner
from tessera.operators.models import hmm, registry
from tessera.sources import providers


def panel(spark, n=160, assets=("a", "b")):
    rng = np.random.default_rng(0)
    rows = []
    for a in assets:
        s = (np.arange(n) // 20) % 2
        rows += [(a, t, float(rng.normal(4 * k, 1)), float(k), int(k)) for t, k in enumerate(s)]
    return spark.createDataFrame(rows, "asset string, t long, ret double, vol double, state int")


@pytest.mark.parametrize("name", ["gaussian-hmm", "markov-switching-ar", "kmeans", "ticc", "hierarchical", "jump-segmentation", "recurrent-switching-lds", "threshold-autoregression", "smooth-transition-autoregression", "switching-copula", "switching-volatility", "pelt", "page-hinkley", "volatility-rule", "markov-switching-garch", "logistic-classifier", "transition-hazard"])
def test_every_family_runs_by_name(spark, name):
    label = {"logistic-classifier": {"label": "vol"}}.get(name, {})
    got = registry.create(name, label).run(panel(spark, 60), ["ret", "vol"][: 2 if name == "switching-copula" else 1])
    assert "state" in got.columns and got.count() >= 100


def test_configurations_are_checked():
    assert registry.configuration("kmeans", {"k": 3})["k"] == 3 and registry.create("pelt").configuration["family"] == "changepoint"
    for bad in (("kmeans", {"q": 1}), ("kmeans", {"k": "two"})):
        with pytest.raises(ValueError):
            registry.configuration(*bad)
    with pytest.raises(KeyError):
        registry.spec("gaussian-nothing")
    with pytest.raises(NotImplementedError):
        registry.create("hdp-hmm")
    assert set(hmm.VARIANTS) <= set(registry.available()) and registry.describe("cusum")["defaults"]["least"] == 5


def test_evaluation_over_windows(spark, tmp_path):
    e = runner.Evaluation.parse({"model": "gaussian-hmm", "parameters": {"restarts": 1}, "features": ["ret"], "validation": {"train": 60, "validation": 20, "test": 20}, "metrics": list(runner.METRICS), "truth": "state"})
    df = panel(spark)
    r = runner.evaluate(df, e, str(tmp_path))
    assert r.summary["n_windows"] == 8 and r.summary["n_predictions"] == 8 * 40
    assert r.summary["regime_persistence"] > 0.85 and r.summary["brier_score"] < 0.1 and 0 <= r.summary["transition_stability"] < 1
    # metrics against a plain version of one window
    w = r.predictions.filter("asset = 'a' and split = 1").orderBy("t").toPandas()
    row = r.windows.filter("asset = 'a' and split = 1").first()
    s = w.state.to_numpy()
    assert row.rows == len(w) and row.regime_persistence == pytest.approx((s[1:] == s[:-1]).mean())
    share = np.bincount(s)[np.bincount(s) > 0] / len(s)
    assert row.state_entropy == pytest.approx(-(share * np.log2(share)).sum())
    p = np.array(w.probabilities.tolist())
    assert row.probability_entropy == pytest.approx(np.mean(-(np.clip(p, 1e-300, 1) * np.log2(np.clip(p, 1e-300, 1))).sum(1)), abs=1e-6)
    again = runner.evaluate(df.limit(0), e, str(tmp_path))  # kept, not run again
    assert again.summary["n_predictions"] == r.summary["n_predictions"]
    for bad in ({"model": "kmeans"}, {"metrics": ["none"]}, {"other": 1}):
        with pytest.raises(ValueError):
            runner.Evaluation.parse(bad)


def test_states_are_aligned_to_the_first_split(spark):
    rows = [("a", sp, t, s, float(v)) for sp, flip in ((0, False), (1, True)) for t in range(10) for s, v in [((t % 2) ^ flip, 10 * (t % 2))]]
    df = spark.createDataFrame(rows, "asset string, split int, t long, unaligned_state int, x double")
    got = {(r.split, r.unaligned_state): r.aligned for r in runner.mappings(df, ["x"], "asset").collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0}


def test_contracts():
    base = {k: {"x": 1} for k in runner.CONTRACT}
    assert runner.differences({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3}, "d": 4}) == {"a.c": (2, 3), "d": (None, 4)}
    runner.assert_comparable(base, base)
    with pytest.raises(runner.ContractError):
        runner.assert_comparable(base, base | {"costs": {"x": 2}})
    with pytest.raises(runner.ContractError):
        runner.assert_comparable(base, {})
    got = runner.compared({"a": (base, {"m": 2.0}), "b": (base, {"m": 1.0}), "c": (base, {}), "d": (base | {"target": 0}, {"m": 0.0})}, "m")
    assert [n for n, _ in got["ranked"]] == ["b", "a"] and got["missing_metric"] == [("c", None)] and got["incompatible"][0][0] == "d"


STUDY = {"name": "s", "source": {"kind": "events", "path": "/root/testdata/sf0.001"}, "features": {"columns": ["ret"]}, "validation": {"train": 0.5, "validation": 0.15, "test": 0.15}, "models": {"candidates": [{"name": "plain", "model": "gaussian-hmm", "parameters": {"restarts": 1, "iterations": 5}}, {"name": "sticky", "model": "sticky-hmm", "parameters": {"restarts": 1, "iterations": 5}}]}, "comparison": {"metric": "switching_frequency", "lower_is_better": True}}


def test_a_study_from_its_document(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text(json.dumps(STUDY))
    assert workflow.dry_run(str(path)) == [] and [s.name for s in workflow.plan(str(path)).stages] == list(workflow.STAGES)
    bad = workflow.dry_run(STUDY | {"models": {"candidates": [{"model": "kmeans"}, {"model": "none"}]}, "source": {"kind": "x", "path": "y"}})
    assert len(bad) == 3 and workflow.dry_run({"what": {}}) == ["no stage what"]
    done = workflow.run(spark, str(path), str(tmp_path / "e"))
    assert [n for n, _ in done["comparison"]["ranked"]] in (["sticky", "plain"], ["plain", "sticky"]) and "<svg" in open(done["report"]).read()
    b = workflow.Browser(str(tmp_path / "e"))
    assert b.runs()[0]["status"] == "completed" and b.matching(done["run"], "COMPARISON")
    assert b.load_table(spark, b.matching(done["run"], "comparison")[0][1]).count() == 1
    r = runner.evaluate(panel(spark), runner.Evaluation(parameters={"restarts": 1}, validation=runner.Validation(train=60, validation=20, test=20)))
    assert all("<svg" in v for v in workflow.figures(spark, r.predictions, r.windows).values())


def test_models_from_a_folder(tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.yaml").write_text(json.dumps({"model": "kmeans", "parameters": {"k": 3}}))
    (tmp_path / "b.yml").write_text(json.dumps({"other": 1}))
    assert workflow.discover(str(tmp_path)) == [{"path": "m/a.yaml", "model": "kmeans", "parameters": {"k": 3}}]


def test_searches(tmp_path):
    got = workflow.search({"x": [0.0, 1.0], "k": ["a", "b"]}, workflow.MetricObjective(lambda p: {"m": (p["x"] - 0.4) ** 2 + (p["k"] == "b"), "c": p["x"]}, {"m": 1.0}, {"c": (None, 0.9)}), 60)
    assert got["value"] < 0.01 and got["parameters"]["k"] == "a" and got["void"] > 0
    stop = workflow.EarlyStopping(2, 3)
    assert [stop(v) for v in (1.0, 2.0, 3.0)] == [False, False, True]
    f = workflow.nested_objective(lambda p, fold: p["x"] * fold, [1, 2, 3], prune=lambda s: s[-1] > 5)
    assert f({"x": 1.0}) == 2.0 and f({"x": 3.0}) == float("inf")
    path = tmp_path / "t.yaml"
    path.write_text(json.dumps({"model": "gaussian-hmm", "space": {"states": [2, 3]}, "trials": 2}))
    assert workflow.Tuning.from_yaml(str(path)).trials == 2
    with pytest.raises(ValueError):
        workflow.Tuning("gaussian-hmm", {"none": [1, 2]})


def test_providers(spark, monkeypatch):
    waited = []
    clock = iter([0.0, 0.0, 0.2, 1.0, 1.5, 1.5])
    limit = providers.RateLimit(1.0, waited.append, lambda: next(clock))
    assert limit.wait() == 0 and limit.wait() == pytest.approx(0.8) and waited == [pytest.approx(0.8)]
    m = providers.MockProvider(rows=25)
    assert set(m.capabilities()) == set(providers.DOMAINS) and m.capabilities()["equity_ohlcv"].adjusted
    for d in providers.DOMAINS:
        assert m.table(spark, providers.Request(d, ("X", "Y"), page_size=7)).count() == 50
    assert len(list(m.pages(providers.Request("fx", ("X",), page_size=10)))) == 3
    assert m.mapped(providers.Identifier("SPY"), "figi").value == "figi:SPY" and m.mapped(providers.Identifier("SPY"), "symbol").value == "SPY"
    with pytest.raises(ValueError):
        providers.Request("none")

    class Flaky(providers.MockProvider):
        calls = 0

        def fetch(self, request):
            Flaky.calls += 1
            if Flaky.calls == 1:
                raise OSError("once")
            return super().fetch(request)

    assert len(Flaky(rows=3, wait=0.0).page(providers.Request("rates", ("X",)))[0]) == 3 and Flaky.calls == 2
    monkeypatch.setenv("TESSERA_K", "v")
    assert providers.interpolated({"a": ["${TESSERA_K}", "${TESSERA_NONE:-d}"], "b": 1}) == {"a": ["v", "d"], "b": 1}
    with pytest.raises(KeyError):
        providers.interpolated("${TESSERA_NONE}")
    assert "secret" not in repr(providers.Credentials.load(["K"], {"K": "secret"}))
    with pytest.raises(KeyError):
        providers.Credentials.load(["K"], {})
    assert providers.symbols_from({"symbols": ["a", "A ", "b"]}) == ["A", "B"] and providers.symbols_from({"symbol": "x"}) == ["X"]
    got = providers.ingest(spark, {"symbols": ["a"], "domains": ["equity_ohlcv", "greeks"]})
    assert set(got) == {"equity_ohlcv", "greeks"} and got["equity_ohlcv"].filter("symbol = 'A'").count() == 10


def test_charts():
    trials = [{"a": 1.0, "b": 5.0}, {"a": 2.0, "b": 2.0}, {"a": 3.0, "b": 3.0}, {"a": 4.0, "b": 1.0}, {"a": None, "b": 0.0}]
    assert charts.pareto_front(trials, ("a", "b")) == [trials[0], trials[1], trials[3]]
    made = [charts.line_chart({"x<": [1.0, None, 2.0]}, "t"), charts.regime_time_series([1.0, 2.0, 3.0], [0, 0, 1]), charts.probability_area_chart([[0.2, 0.8], [0.5, 0.5]]), charts.heatmap([[1.0, 2.0], [3.0, None]], "h", ["a", "b"], ["c", "d"]), charts.bar_chart({"a": -1.0, "b": 2.0}, "b"), charts.distribution_by_state({0: [0.0, 1.0, 2.0, 3.0, 4.0]}, "d"), charts.scatter_chart([1.0, 2.0], [3.0, 4.0], "s", "x", "y", [0, 1]), charts.pareto_tradeoff_chart(trials, ("a", "b")), charts.bar_chart({}, "empty")]
    import xml.etree.ElementTree as ET

    for m in made:
        assert ET.fromstring(m).tag.endswith("svg")
    assert charts.line_chart({"x": [1.0, None, 2.0, 3.0]}, "t").count("<polyline") == 2


def test_tables_of_surfaces_and_shares(spark):
    pts = spark.createDataFrame([(0.1, 0.9, 0.2), (0.1, 0.9, 0.4), (0.1, 1.1, 0.5), (0.5, 0.9, 0.1)], "tenor double, moneyness double, iv double")
    got = runner.surface(pts, levels=[0.9, 1.1]).collect()
    assert [tuple(r) for r in got] == [(0.1, pytest.approx(0.3), 0.5), (0.5, 0.1, None)]
    shares = runner.occupancy_crosstab(spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 2)], "a int, b int"), "a", "b")
    assert shares.groupBy("a").agg(F.sum("share").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    assert runner.infer_features(panel(spark, 4)) == ["ret", "vol", "state"]


def test_command_line(tmp_path, capsys):
    assert experiments.main(["models", "--family", "rule"]) == 0 and "volatility-rule" in capsys.readouterr().out
    assert experiments.main(["describe", "pelt"]) == 0 and json.loads(capsys.readouterr().out)["defaults"]["penalty"] == 3.0
    (tmp_path / "s.yaml").write_text(json.dumps(STUDY))
    assert experiments.main(["plan", str(tmp_path / "s.yaml")]) == 0 and "evaluation after features" in capsys.readouterr().out
    (tmp_path / "i.yaml").write_text(json.dumps({"symbols": ["x"], "domains": ["rates"]}))
    assert experiments.main(["ingest", str(tmp_path / "i.yaml"), "--output", str(tmp_path / "o")]) == 0 and (tmp_path / "o" / "rates").exists()


def test_protocols_and_runtime(spark):
    from tessera import protocols, runtime
    from tessera.operators import changepoint

    assert isinstance(changepoint.cusum, protocols.Detector) and isinstance(runtime.SparkMapper(spark), protocols.Mapper)
    assert issubclass(protocols.Unsupported, NotImplementedError)
    with pytest.raises(protocols.Unsupported):
        protocols.PanelModel().smooth(None)
    assert list(runtime.chunked(range(5), 2)) == [[0, 1], [2, 3], [4]]
    assert [c.shape for c in runtime.array_chunks(np.zeros((5, 3)), 2, 1)] == [(5, 2), (5, 1)] and [len(c) for c in runtime.array_chunks(np.zeros(5), 2)] == [2, 2, 1]
    assert runtime.run_batch(lambda x: x * x, [3, 1, 2], runtime.SparkMapper(spark, 2)) == [9, 1, 4] == runtime.run_batch(lambda x: x * x, [3, 1, 2])
    assert list(runtime.SparkMapper(spark).map(len, [])) == []
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("again")
        return x

    assert runtime.Retryable(flaky, 3, 0.0)(7) == 7 and len(calls) == 3
    with pytest.raises(ValueError):
        list(runtime.chunked([1], 0))


def test_metric_descriptors():
    assert set(runner.DESCRIPTORS) == set(runner.METRICS)
    d = runner.DESCRIPTORS["brier_score"]
    assert d.compatible({"probabilities", "truth", "states"}, "filtered") and not d.compatible({"probabilities", "truth"}, "smoothed") and not d.compatible({"truth"}, "filtered")
    assert runner.DESCRIPTORS["probability_entropy"].compatible({"probabilities"}, "smoothed")
