"""Alignment, explicit durations, switching regressions and segmentations against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import alignment, downstream, rules, states
from tessera.operators.models import hmm, other


def test_alignment_by_descriptors(spark):
    rng = np.random.default_rng(0)
    s = np.repeat([0, 1, 2, 0, 1, 2], 40)
    rows = [("a", t, float(rng.normal([0, 5, -4][k], [1, 0.3, 2][k])), int(k), int([2, 0, 1][k])) for t, k in enumerate(s)]
    df = spark.createDataFrame(rows, "asset string, t long, x double, state int, other int")
    got = alignment.align(alignment.describe(df, ["x"]), alignment.describe(df, ["x"], "other"))
    assert got.mapping == {2: 0, 0: 1, 1: 2} and got.total == pytest.approx(0, abs=1e-9) and not got.ambiguous
    assert got.relabelled([2, 0, 1, 9]) == [0, 1, 2, 9]
    assert set(got.parts[0, 2]) == set(alignment.DISTANCES)


def test_alignment_costs_and_errors():
    ref = {"state_means": {0: [0.0, 0.0], 1: [3.0, 4.0]}, "durations": {0: [1, 2, 3], 1: [4, 5]}}
    cand = {"state_means": {5: [3.0, 4.0], 6: [0.0, 1.0]}}
    got = alignment.align(ref, cand, alignment.Method(weights={"state_means": 2.0}))
    assert got.costs.tolist() == [[10.0, 2.0], [0.0, 2 * np.hypot(3, 3)]] and got.mapping == {6: 0, 5: 1}
    with pytest.raises(ValueError):
        alignment.align(ref, cand, "covariances")
    with pytest.warns(RuntimeWarning):
        assert alignment.align({"state_means": {0: [0.0], 1: [0.001]}}, {"state_means": {0: [0.0005], 1: [0.0005]}}).ambiguous


def test_earth_mover_and_sorted_moves():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=7)
    assert alignment.earth_mover(a, b) == pytest.approx(np.abs(np.sort(a) - np.sort(b)).mean())
    assert alignment.distance("transitions", [0.1, 0.9], [0.9, 0.1]) == 0


def test_every_step_sets_the_stay_by_the_mean_duration():
    c = hmm.variant("hsmm")
    got = hmm._moves(np.array([[8.0, 2.0], [1.0, 9.0]]), c)
    assert np.allclose(got, [[0.9 / 1.1, 0.2 / 1.1], [0.1, 0.9]], atol=1e-6)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 1, 20) for m in (0, 3, 0, 3, 0, 3)])[:, None]
    p, free = hmm.fit(x, c), hmm.fit(x)
    assert not np.allclose(p.moves, free.moves) and np.allclose(p.moves.sum(1), 1)
    mass = hmm.duration_pmf(p, 50)
    assert np.allclose(mass.sum(1), 1) and np.all(np.diff(mass, axis=1) < 0)


def test_mixture_start_differs_from_kmeans_and_recovers():
    rng = np.random.default_rng(3)
    s = np.repeat([0, 1, 0, 1], 100)
    x = np.where(s == 0, rng.normal(0, 0.3, 400), rng.normal(0.5, 3.0, 400))[:, None]
    w, means, covs = hmm.gaussian_mixture(x, 2, np.random.default_rng(0), 1e-4)
    assert w.sum() == pytest.approx(1) and covs.min() > 0 and covs.max() / covs.min() > 10
    first = hmm.first_params(x, hmm.variant("gmm-hmm"), 0)
    assert np.all(first.moves == 0.5)
    p = hmm.fit(x, hmm.variant("gmm-hmm"))
    _, g, _, _ = hmm.smooth(hmm.emissions(x, p), p)
    assert max((g.argmax(1) == s).mean(), (g.argmax(1) != s).mean()) > 0.9


def test_switching_regression_recovers_coefficients():
    rng = np.random.default_rng(4)
    s = np.repeat([0, 1, 0, 1], 120)
    u = rng.normal(size=480)
    y = np.where(s == 0, -1 + 2 * u, 3 - 1 * u) + 0.2 * rng.normal(size=480)
    p = hmm.fit_regressions(y, u[:, None], hmm.variant("markov-switching-regression"))
    assert np.allclose(p.coefficients, [[-1, 2], [3, -1]], atol=0.1) and np.allclose(p.variances, 0.04, atol=0.05)
    # an autoregression: each state's own lag
    y = np.zeros(480)
    for t in range(1, 480):
        y[t] = (0.9 * y[t - 1] + 0.1 if s[t] else -0.7 * y[t - 1] - 0.5) + 0.05 * rng.normal()
    p, density = hmm.learned(np.column_stack([y[1:], y[:-1]]), hmm.variant("markov-switching-ar"))
    assert np.allclose(sorted(p.coefficients[:, 1]), [-0.7, 0.9], atol=0.1) and density(np.zeros((3, 2))).shape == (3, 2)


def test_filter_of_modes_against_one_mode():
    """With one mode the mixture is a plain Kalman filter."""
    rng = np.random.default_rng(5)
    y, a, q, r = rng.normal(size=(30, 2)), np.array([[0.9, 0.1], [0.0, 0.8]]), np.eye(2) * 0.3, np.eye(2) * 0.2
    _, got = other.kalman_switching(y, [{"A": a, "Q": q, "C": np.eye(2), "R": r}], np.ones((1, 1)))
    m, p = np.zeros(2), np.eye(2)
    for t, row in enumerate(y):
        m, p = a @ m, a @ p @ a.T + q
        k = p @ np.linalg.inv(p + r + 1e-9 * np.eye(2))
        m, p = m + k @ (row - m), p - k @ p
        assert np.allclose(got[t], m)
    z = np.repeat([[0.0, 0.0], [4.0, 4.0]], 40, axis=0) + rng.normal(size=(80, 2)) * 0.1
    assert np.array_equal(other.switching_lds(z), other.switching_lds(z, recurrent=np.zeros((2, 2))))
    tilted = other.recurrent_moves(np.full((2, 2), 0.5), np.array([[0.0], [50.0]]), np.array([[0.0], [1.0]]))
    assert np.allclose(tilted[0], 0.5) and np.allclose(tilted[1], [[0, 1], [0, 1]])


def test_windows_in_segments_and_sparse_precision():
    rng = np.random.default_rng(6)
    a = rng.multivariate_normal([0, 0], [[1, 0.95], [0.95, 1]], 150)
    b = rng.multivariate_normal([4, -4], [[1, -0.95], [-0.95, 1]], 150)
    lab, precision = other.ticc(np.concatenate([a, b]), 2, 4, 10.0)
    assert len(lab) == 300 and len(set(lab[:140])) == 1 and len(set(lab[160:])) == 1 and lab[0] != lab[-1]
    assert precision[lab[0]][0, 1] < 0 < precision[lab[-1]][0, 1]
    x = rng.normal(size=(400, 3))
    cov = np.cov(x, rowvar=False)
    w, _ = other.graphical_lasso(cov, 1e-8)
    assert np.allclose(w, cov, atol=1e-4)
    assert np.allclose(other.graphical_lasso(cov, 10.0)[1][~np.eye(3, dtype=bool)], 0)
    with pytest.raises(ValueError):
        other.ticc(x[:3], window=5)


def test_default_rules_and_saved_models(spark):
    df = spark.createDataFrame([("a", 0, 0.3, 0.1), ("a", 1, 0.1, 0.9), ("a", 2, None, 0.5)], "asset string, t long, volatility double, breadth double")
    assert set(rules.DEFAULTS) == {"volatility", "correlation", "liquidity", "breadth", "trend", "credit", "skew", "term_structure"}
    m = rules.RuleModel(rules.default_rule("volatility"))
    assert [r.state for r in m.fit(df).predict(df).orderBy("t").collect()] == [1, 0, None]
    again = rules.RuleModel.from_json(m.to_json())
    assert again.rule == m.rule
    assert [r.state for r in rules.default_rule("breadth", value=0.4).predict(df).orderBy("t").collect()] == [1, 0, 0]


def test_recommended_tasks_and_improvement(spark):
    design = downstream.Design((0, 59), (60, 99), costs={"proportional_cost": 0.001, "half_spread": 0.0005})
    specs = downstream.recommended(("x",), ("p",), design)
    assert [s.name for s in specs] == list(downstream.TARGETS) and design.cost_rate == pytest.approx(0.0015)
    rng = np.random.default_rng(7)
    p = rng.integers(0, 2, 100).astype(float)
    x = rng.normal(size=100)
    y = 0.1 * x + (2 * p - 1) + 0.1 * rng.normal(size=100)
    df = spark.createDataFrame([("a", t, float(x[t]), float(p[t]), float(y[t])) for t in range(100)], "asset string, t long, x double, p double, forward_return double")
    losses, worth = downstream.evaluate(df, downstream.spec("equity_return", ("x",), ("p",), design, realized="forward_return"))
    r = losses.first()
    assert r.relative_improvement > 0.9 and r.absolute_improvement == pytest.approx(r.agnostic_loss - r.aware_loss)
    by = {w.arm: w for w in worth.collect()}
    assert by["aware"].annualized_return > by["agnostic"].annualized_return
    assert downstream.adjustments(20, 5, 0.9) == {"effective_trials": 15.0, "stability": 0.9}
    with pytest.raises(ValueError):
        downstream.spec("none", (), (), design)


def test_jump_costs_by_enumeration():
    rng = np.random.default_rng(8)
    cost = rng.random((6, 3))
    best = min(itertools.product(range(3), repeat=6), key=lambda p: sum(cost[t, k] for t, k in enumerate(p)) + 0.3 * sum(a != b for a, b in itertools.pairwise(p)))
    assert tuple(other.jump_path(cost, 0.3)) == best


def test_hazard_without_a_change(spark):
    df = spark.createDataFrame([("a", t, 1, float(t)) for t in range(10)], "asset string, t long, state int, x double")
    assert {r.hazard for r in other.hazard(df, ["x"]).collect()} == {0.0}
    assert states.transition_events(df).agg(F.sum("event")).first()[0] == 0


def test_density_clusters_and_noise():
    from tessera.operators.models import density

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal([0, 0], 0.2, (60, 2)), rng.normal([5, 5], 0.2, (50, 2)), rng.normal([0, 6], 0.2, (40, 2)), [[20.0, -20.0], [-15.0, 12.0]]])
    order = rng.permutation(len(x))
    truth = np.repeat([0, 1, 2, -1], [60, 50, 40, 2])[order]
    lab = density.hdbscan(x[order], 10)
    assert set(lab[truth == -1]) == {-1} and len({tuple(sorted(set(lab[(truth == k) & (lab >= 0)]))) for k in range(3)}) == 3
    assert all(np.mean(lab[truth == k] >= 0) > 0.8 for k in range(3))
    # the tree is least: as long as Kruskal's over all mutual distances
    y = x[order][:40]
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 5]
    reach = np.maximum(np.maximum(d, core), core[:, None])
    up = list(range(40))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    total = 0.0
    for w, i, j in sorted((reach[i, j], i, j) for i in range(40) for j in range(i)):
        if root(i) != root(j):
            up[root(i)] = root(j)
            total += w
    assert density._spanning_tree(y, 5)[:, 0].sum() == pytest.approx(total)
    states_ = density.density_states(x[order], 10)
    assert states_.min() == 0 and len(set(states_)) == 3
    assert set(density.density_states(rng.normal(size=(6, 1)), 5)) <= {0, 1}


def test_quotes_have_all_columns(spark):
    from tessera.operators import pricing

    got = pricing.quotes(spark.createDataFrame([("SPY260116C00450000", 10.0, 10.4, 0.5)], "symbol string, bid double, ask double, adjustment_factor double")).first()
    assert got.mid == pytest.approx(10.2) and got.notional_mid == pytest.approx(510.0) and got.multiplier == 100.0 and got.volume is None and got.adjusted is False
