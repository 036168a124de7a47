"""Queries of the change-point detectors over hourly closes, and SQL that runs their recursions row by row."""

from __future__ import annotations

from tessera.operators import changepoint
from tessera.plans import inputs as I
from tessera.plans.feature_queries import K, r6

CLOSE = '"close"'
#: Rows with their place in the series, and prefix sums before each place (k from 0 to n).
X = f"""{I.BARS}, x AS MATERIALIZED (SELECT asset, t, {CLOSE} AS v, row_number() OVER (PARTITION BY asset ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM bars),
d AS (SELECT x.asset, i, n, v - m AS v FROM x JOIN (SELECT asset, avg(v) AS m FROM x GROUP BY asset) USING (asset)),
c AS MATERIALIZED (SELECT asset, i + 1 AS k, n, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM d WINDOW w AS (PARTITION BY asset ORDER BY i) UNION ALL SELECT asset, 0, n, 0, 0 FROM d WHERE i = 0)"""


def _detector(method, **how):
    def query(s, d):
        found = changepoint.detect(I.bars(s, d), method, "close", **how)
        return I.rounded(found, [*K, "boundary", "segment"], 5)

    return query


def _told(ctes: str, score: str = "score", cut: str = "cut", recursive: bool = True) -> str:
    """ctes end with ``found`` (asset, i, score, cut)."""
    return f"""WITH {"RECURSIVE " if recursive else ""}{X}, {ctes}, z AS (SELECT x.asset, x.t, x.i, coalesce({score}, 0.0::DOUBLE) AS score, coalesce({cut}, false) AND x.i > 0 AS cut FROM x LEFT JOIN found USING (asset, i))
SELECT asset, t, {r6(5, score="score", probability="coalesce(score / nullif(max(score) OVER (PARTITION BY asset), 0), 0.0::DOUBLE)")}, cut AS boundary, sum(CAST(cut AS INT)) OVER (PARTITION BY asset ORDER BY i) AS segment FROM z"""


def _cusum(threshold: float, drift: float, least: int) -> str:
    z = "(x.v - r.mean) / r.sd"
    return _told(f"""b AS (SELECT asset, avg(v) AS mean, coalesce(nullif(stddev_samp(v), 0), 1.0::DOUBLE) AS sd FROM x WHERE i < {least} GROUP BY asset),
r AS (SELECT asset, CAST(-1 AS BIGINT) AS i, mean, sd, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0.0::DOUBLE AS score, false AS cut FROM b
UNION ALL SELECT asset, i, CASE WHEN cut THEN v ELSE mean END, sd, CASE WHEN cut THEN 0 ELSE up END, CASE WHEN cut THEN 0 ELSE down END, score, cut
FROM (SELECT *, greatest(up, down) AS score, i >= {least} AND greatest(up, down) >= {threshold}::DOUBLE AS cut
FROM (SELECT x.asset, x.i, x.v, r.mean, r.sd, greatest(0.0::DOUBLE, r.up + {z} - {drift}::DOUBLE) AS up, greatest(0.0::DOUBLE, r.down - {z} - {drift}::DOUBLE) AS down FROM r JOIN x ON x.asset = r.asset AND x.i = r.i + 1))),
found AS (SELECT * FROM r WHERE i >= 0)""")


def _page_hinkley(threshold: float, delta: float, alpha: float, least: int) -> str:
    return _told(f"""r AS (SELECT DISTINCT asset, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS total, 0.0::DOUBLE AS low, 0.0::DOUBLE AS score, false AS cut FROM x
UNION ALL SELECT asset, i, CASE WHEN cut THEN v ELSE mean END, CASE WHEN cut THEN 0 ELSE total END, CASE WHEN cut THEN 0 ELSE low END, score, cut
FROM (SELECT *, total - low AS score, i >= {least} AND total - low >= {threshold}::DOUBLE AS cut
FROM (SELECT *, least(before, total) AS low FROM (SELECT *, {alpha}::DOUBLE * faded + v - mean - {delta}::DOUBLE AS total
FROM (SELECT x.asset, x.i, x.v, r.mean + (x.v - r.mean) / (x.i + 1) AS mean, r.total AS faded, r.low AS before FROM r JOIN x ON x.asset = r.asset AND x.i = r.i + 1))))),
found AS (SELECT * FROM r WHERE i >= 0)""")


def _gain(a: str, k: str, b: str) -> str:
    cost = lambda p, q: f"({q}.q - {p}.q - ({q}.s - {p}.s) * ({q}.s - {p}.s) / ({q}.k - {p}.k))"
    return f"{cost(a, b)} - {cost(a, k)} - {cost(k, b)}"


def _segmentation(most: int, least: int, threshold: float) -> str:
    parts = ["seg0 AS MATERIALIZED (SELECT DISTINCT asset, 0 AS a, n AS b, 0 AS place FROM x)"]
    for r in range(most):
        parts.append(f"""ends{r} AS MATERIALIZED (SELECT g.*, ca.s AS s1, ca.q AS q1, cb.s AS s2, cb.q AS q2 FROM seg{r} g JOIN c ca ON ca.asset = g.asset AND ca.k = g.a JOIN c cb ON cb.asset = g.asset AND cb.k = g.b),
cand{r} AS MATERIALIZED (SELECT g.asset, a, b, place, ck.k, (q2 - q1 - (s2 - s1) * (s2 - s1) / (b - a)) - (ck.q - q1 - (ck.s - s1) * (ck.s - s1) / (ck.k - a)) - (q2 - ck.q - (s2 - ck.s) * (s2 - ck.s) / (b - ck.k)) AS gain FROM ends{r} g JOIN c ck ON ck.asset = g.asset AND ck.k >= g.a + {least} AND ck.k <= g.b - {least}),
best{r} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY gain DESC, place, k) AS nth FROM cand{r}) WHERE nth = 1 AND gain >= {threshold}::DOUBLE),
seg{r + 1} AS MATERIALIZED (SELECT g.* FROM seg{r} g LEFT JOIN best{r} h ON h.asset = g.asset AND h.a = g.a WHERE h.k IS NULL UNION ALL SELECT asset, a, k, {2 * r + 1} FROM best{r} UNION ALL SELECT asset, k, b, {2 * r + 2} FROM best{r})""")
    gains = " UNION ALL ".join(f"SELECT asset, k, gain FROM cand{r}" for r in range(most))
    cuts = " UNION ALL ".join(f"SELECT asset, k FROM best{r}" for r in range(most))
    parts.append(f"found AS (SELECT g.asset, g.k AS i, greatest(max(gain), 0.0::DOUBLE) AS score, max(h.k) IS NOT NULL AS cut FROM ({gains}) g LEFT JOIN ({cuts}) h ON h.asset = g.asset AND h.k = g.k GROUP BY 1, 2)")
    return _told(", ".join(parts), recursive=False)


def _partition(penalty: float, least: int) -> str:
    """The whole recursion, every candidate kept."""
    cost = "r.best[a + 1] + l.q[r.t + 2] - l.q[a + 1] - (l.s[r.t + 2] - l.s[a + 1]) * (l.s[r.t + 2] - l.s[a + 1]) / (r.t + 1 - a)"
    return _told(f"""l AS MATERIALIZED (SELECT asset, n, list(s ORDER BY k) AS s, list(q ORDER BY k) AS q FROM c GROUP BY asset, n),
r AS (SELECT asset, n, CAST(0 AS BIGINT) AS t, [{-penalty}::DOUBLE] AS best, [CAST(0 AS BIGINT)] AS back FROM l
UNION ALL SELECT asset, n, t, list_append(best, coalesce(list_min(costs) + {penalty}::DOUBLE, CAST('inf' AS DOUBLE))), list_append(back, coalesce(list_position(costs, list_min(costs)) - 1, 0))
FROM (SELECT r.asset, r.n, r.t + 1 AS t, r.best, r.back, list_transform(range(0, r.t + 2 - {least}), lambda a: {cost}) AS costs FROM r JOIN l ON l.asset = r.asset WHERE r.t < r.n)),
w AS (SELECT asset, back, back[n + 1] AS last FROM r WHERE t = n UNION ALL SELECT asset, back, back[last + 1] FROM w WHERE last > 0),
gains AS (SELECT cm.asset, cm.k AS i, greatest({_gain("ca", "cm", "cb")}, 0.0::DOUBLE) AS score FROM c cm JOIN c ca ON ca.asset = cm.asset AND ca.k = cm.k - {least} JOIN c cb ON cb.asset = cm.asset AND cb.k = cm.k + {least} WHERE cm.k + {least} < cm.n),
found AS (SELECT g.asset, g.i, g.score, w.last IS NOT NULL AS cut FROM (SELECT x.asset, x.i, coalesce(score, 0) AS score FROM x LEFT JOIN gains USING (asset, i)) g LEFT JOIN w ON w.asset = g.asset AND w.last = g.i AND w.last > 0)""")


def _peaks(scores: str, threshold: float, radius: int) -> str:
    """scores: a statement of asset, i, score; of the candidates by falling score those that are far from all kept ones."""
    return f"""sc AS MATERIALIZED ({scores}), cand AS MATERIALIZED (SELECT asset, i, row_number() OVER (PARTITION BY asset ORDER BY round(score, 9) DESC, i) AS nth FROM sc WHERE score >= {threshold}::DOUBLE),
r AS (SELECT DISTINCT asset, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS kept FROM x
UNION ALL SELECT r.asset, cand.nth, CASE WHEN len(list_filter(r.kept, lambda k: abs(k - cand.i) <= {radius})) = 0 THEN list_append(r.kept, cand.i) ELSE r.kept END FROM r JOIN cand ON cand.asset = r.asset AND cand.nth = r.nth + 1),
kept AS (SELECT asset, unnest(kept) AS i FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY nth DESC) AS last FROM r) WHERE last = 1),
found AS (SELECT sc.asset, sc.i, sc.score, kept.i IS NOT NULL AS cut FROM sc LEFT JOIN kept USING (asset, i))"""


def _ks(window: int, threshold: float) -> str:
    return _told(_peaks(f"""SELECT asset, i, max(abs(a - b)) / {window}.0::DOUBLE AS score FROM (SELECT x.asset, x.i, z.i AS at, sum(CAST(y.i < x.i AND y.v <= z.v AS INT)) AS a, sum(CAST(y.i >= x.i AND y.v <= z.v AS INT)) AS b
FROM x JOIN x z ON z.asset = x.asset AND z.i >= x.i - {window} AND z.i < x.i + {window} JOIN x y ON y.asset = x.asset AND y.i >= x.i - {window} AND y.i < x.i + {window} WHERE x.i >= {window} AND x.i < x.n - {window} GROUP BY 1, 2, 3) GROUP BY 1, 2""", threshold, window))


def _kernel(window: int, threshold: float) -> str:
    side = lambda f: f"sum(CASE WHEN {f} THEN k END) / {window * window}"
    return _told(_peaks(f"""SELECT x.asset, x.i, sqrt(greatest(0.0::DOUBLE, {side("p.a < x.i AND p.b < x.i")} + {side("p.a >= x.i AND p.b >= x.i")} - 2 * {side("p.a < x.i AND p.b >= x.i")})) AS score
FROM x JOIN (SELECT y.asset, y.i AS a, z.i AS b, exp(-(y.v - z.v) * (y.v - z.v) / greatest(var, 1e-6)) AS k FROM x y JOIN (SELECT asset, var_pop(v) AS var FROM x GROUP BY asset) g USING (asset) JOIN x z ON z.asset = y.asset AND abs(z.i - y.i) < {2 * window}) p
ON p.asset = x.asset AND p.a >= x.i - {window} AND p.a < x.i + {window} AND p.b >= x.i - {window} AND p.b < x.i + {window} WHERE x.i >= {window} AND x.i < x.n - {window} GROUP BY 1, 2""", threshold, window))


def _bayesian(hazard: float, threshold: float, least: int, short: int) -> str:
    """Lists by run length; the place j of a list is a run of j rows."""
    s2 = "(b[j + 1] * (2.0::DOUBLE + j) / ((1 + j / 2.0::DOUBLE) * (1.0::DOUBLE + j)))"
    density = f"p[j + 1] * exp(lgamma(1.5::DOUBLE + j / 2.0::DOUBLE) - lgamma(1 + j / 2.0::DOUBLE) - 0.5::DOUBLE * ln((2.0::DOUBLE + j) * pi() * {s2}) - (1.5::DOUBLE + j / 2.0::DOUBLE) * ln(1 + (v - mu[j + 1]) * (v - mu[j + 1]) / ((2.0::DOUBLE + j) * {s2})))"
    return _told(f"""r AS (SELECT DISTINCT asset, CAST(-1 AS BIGINT) AS i, [1.0::DOUBLE] AS p, [0.0::DOUBLE] AS mu, [1.0::DOUBLE] AS b FROM x
UNION ALL SELECT asset, i, list_concat([{hazard}::DOUBLE], list_transform(likely, lambda k: k * {1 - hazard}::DOUBLE / list_sum(likely))), list_concat([0.0::DOUBLE], list_transform(range(0, i + 1), lambda j: ((1 + j) * mu[j + 1] + v) / (2 + j))),
list_concat([1.0::DOUBLE], list_transform(range(0, i + 1), lambda j: b[j + 1] + (1 + j) * (v - mu[j + 1]) * (v - mu[j + 1]) / (2 * (2 + j))))
FROM (SELECT *, list_transform(range(0, i + 1), lambda j: {density}) AS likely FROM (SELECT x.asset, x.i, x.v, r.p, r.mu, r.b FROM r JOIN x ON x.asset = r.asset AND x.i = r.i + 1))),
sc AS (SELECT asset, i, list_sum(p[1:{short + 1}]) AS score FROM r WHERE i >= 0), found AS (SELECT sc.asset, sc.i, sc.score, h.i IS NOT NULL AS cut FROM sc LEFT JOIN (SELECT DISTINCT asset, greatest(i - {short}, 0) AS i FROM sc WHERE i >= {least} AND score >= {threshold}::DOUBLE) h USING (asset, i))""")


def queries() -> dict:
    return {
        "changepoint_cusum": _detector("cusum"),
        "changepoint_page_hinkley": _detector("page_hinkley", threshold=20.0),
        "changepoint_binary_segmentation": _detector("binary_segmentation"),
        "changepoint_pelt": _detector("pelt", penalty=500.0),
        "changepoint_distributional": _detector("distributional", kernel=False, threshold=0.5),
        "changepoint_mmd": _detector("distributional", threshold=0.5),
        "changepoint_bocpd": _detector("bocpd"),
        "changepoint_bocpd_short_runs": _detector("bocpd", short=3),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "changepoint_cusum": _cusum(5.0, 0.0, 5),
        "changepoint_page_hinkley": _page_hinkley(20.0, 0.005, 0.999, 5),
        "changepoint_binary_segmentation": _segmentation(5, 5, 1.0),
        "changepoint_pelt": _partition(500.0, 5),
        "changepoint_distributional": _ks(20, 0.5),
        "changepoint_mmd": _kernel(20, 0.5),
        "changepoint_bocpd": _bayesian(0.01, 0.5, 5, 0),
        "changepoint_bocpd_short_runs": _bayesian(0.01, 0.5, 5, 3),
    }
