"""Charts of small aggregated results as SVG text; the aggregation is Spark's work and comes before."""

from __future__ import annotations

import html
import math

WIDTH, HEIGHT, EDGE = 640, 260, 40
# Colours by state, readable side by side for most eyes.
COLOURS = ("#0072b2", "#e69f00", "#009e73", "#cc79a7", "#56b4e9", "#d55e00", "#f0e442", "#666666")


def colour(k: int) -> str:
    return COLOURS[k % len(COLOURS)]


def _number(v: float) -> str:
    return f"{v:.4g}"


class _Scale:
    def __init__(self, values, lo: float, hi: float):
        xs = [float(v) for v in values if v is not None and math.isfinite(v)]
        self.least, self.most = (min(xs), max(xs)) if xs else (0.0, 1.0)
        self.lo, self.hi = lo, hi

    def __call__(self, v: float) -> float:
        return self.lo + (self.hi - self.lo) * (v - self.least) / ((self.most - self.least) or 1.0)


def _frame(title: str, body: str, x: _Scale | None = None, y: _Scale | None = None, labels: tuple[str, str] = ("", ""), legend: list[str] = ()) -> str:
    marks = [f'<text x="{WIDTH / 2}" y="16" text-anchor="middle" font-weight="bold">{html.escape(title)}</text>']
    if x:
        marks += [f'<text x="{x(v):.1f}" y="{HEIGHT - EDGE + 14}" text-anchor="middle">{_number(v)}</text>' for v in (x.least, x.most)]
    if y:
        marks += [f'<text x="{EDGE - 4}" y="{y(v) + 4:.1f}" text-anchor="end">{_number(v)}</text>' for v in (y.least, y.most)]
    marks.append(f'<text x="{WIDTH / 2}" y="{HEIGHT - 6}" text-anchor="middle">{html.escape(labels[0])}</text><text x="12" y="{HEIGHT / 2}" transform="rotate(-90 12 {HEIGHT / 2})" text-anchor="middle">{html.escape(labels[1])}</text>')
    marks += [f'<text x="{WIDTH - 4}" y="{30 + 13 * k}" text-anchor="end" fill="{colour(k)}">{html.escape(str(n))}</text>' for k, n in enumerate(legend)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">{body}{"".join(marks)}</svg>'


def _axes(xs, ys) -> tuple[_Scale, _Scale]:
    return _Scale(xs, EDGE, WIDTH - EDGE), _Scale(ys, HEIGHT - EDGE, 24)


def _path(xs, ys, x, y, k: int = 0) -> str:
    """A line that breaks where a value is missing."""
    runs, run = [], []
    for a, b in zip(xs, ys, strict=True):
        if b is None or not math.isfinite(b):
            runs, run = [*runs, run], []
        else:
            run.append(f"{x(a):.1f},{y(b):.1f}")
    return "".join(f'<polyline fill="none" stroke="{colour(k)}" points="{" ".join(r)}"/>' for r in [*runs, run] if r)


def line_chart(series: dict[str, list[float]], title: str, x_label: str = "", y_label: str = "") -> str:
    n = max((len(v) for v in series.values()), default=0)
    x, y = _axes(range(n), [v for s in series.values() for v in s])
    return _frame(title, "".join(_path(range(len(v)), v, x, y, k) for k, v in enumerate(series.values())), x, y, (x_label, y_label), list(series))


def regime_time_series(values: list[float], states: list[int | None], title: str = "Values by state") -> str:
    """The line over bands in the states' colours."""
    x, y = _axes(range(len(values)), values)
    bands, start = [], 0
    for k in range(1, len(states) + 1):
        if k == len(states) or states[k] != states[start]:
            if states[start] is not None:
                bands.append(f'<rect x="{x(start):.1f}" y="24" width="{max(x(min(k, len(values) - 1)) - x(start), 1):.1f}" height="{HEIGHT - EDGE - 24}" fill="{colour(int(states[start]))}" opacity="0.25"/>')
            start = k
    return _frame(title, "".join(bands) + _path(range(len(values)), values, x, y, 7), x, y)


def probability_area_chart(rows: list[list[float]], title: str = "State probabilities") -> str:
    """Areas one on another; a row's probabilities are taken as shares of their sum."""
    k = max((len(r) for r in rows), default=0)
    x, y = _axes(range(len(rows)), [0.0, 1.0])
    tops = [[0.0] * (k + 1) for _ in rows]
    for t, r in enumerate(rows):
        whole = sum(r) or 1.0
        for j in range(k):
            tops[t][j + 1] = tops[t][j] + (r[j] if j < len(r) else 0.0) / whole
    areas = []
    for j in range(k):
        up = [f"{x(t):.1f},{y(v[j + 1]):.1f}" for t, v in enumerate(tops)]
        down = [f"{x(t):.1f},{y(v[j]):.1f}" for t, v in reversed(list(enumerate(tops)))]
        areas.append(f'<polygon fill="{colour(j)}" opacity="0.7" points="{" ".join(up + down)}"/>')
    return _frame(title, "".join(areas), x, y, legend=[f"state {j}" for j in range(k)])


def heatmap(matrix: list[list[float]], title: str, x_labels: list[str] | None = None, y_labels: list[str] | None = None) -> str:
    cells = [v for r in matrix for v in r if v is not None]
    shade = _Scale(cells, 1.0, 0.1)
    w, h = (WIDTH - 2 * EDGE) / max(max((len(r) for r in matrix), default=1), 1), (HEIGHT - EDGE - 24) / max(len(matrix), 1)
    body = []
    for i, r in enumerate(matrix):
        for j, v in enumerate(r):
            if v is not None:
                g = int(255 * shade(v))
                body.append(f'<rect x="{EDGE + j * w:.1f}" y="{24 + i * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="rgb({g},{g},255)"/><text x="{EDGE + (j + 0.5) * w:.1f}" y="{24 + (i + 0.5) * h + 4:.1f}" text-anchor="middle">{_number(v)}</text>')
    body += [f'<text x="{EDGE + (j + 0.5) * w:.1f}" y="{HEIGHT - EDGE + 14}" text-anchor="middle">{html.escape(str(n))}</text>' for j, n in enumerate(x_labels or [])]
    body += [f'<text x="{EDGE - 4}" y="{24 + (i + 0.5) * h + 4:.1f}" text-anchor="end">{html.escape(str(n))}</text>' for i, n in enumerate(y_labels or [])]
    return _frame(title, "".join(body))


def bar_chart(values: dict[str, float], title: str, y_label: str = "Value") -> str:
    _, y = _axes([0], [0.0, *values.values()])
    w, body = (WIDTH - 2 * EDGE) / max(len(values), 1), []
    for k, (n, v) in enumerate(values.items()):
        top, foot = min(y(v), y(0.0)), max(y(v), y(0.0))
        body.append(f'<rect x="{EDGE + (k + 0.1) * w:.1f}" y="{top:.1f}" width="{0.8 * w:.1f}" height="{foot - top:.1f}" fill="{colour(k)}"/><text x="{EDGE + (k + 0.5) * w:.1f}" y="{HEIGHT - EDGE + 14}" text-anchor="middle">{html.escape(str(n))}</text>')
    return _frame(title, "".join(body), None, y, ("", y_label))


def distribution_by_state(quantiles: dict[int, list[float]], title: str, x_label: str = "Value") -> str:
    """A box for each state from its quantiles: least, quarter, half, three quarters, most."""
    x = _Scale([v for q in quantiles.values() for v in q], EDGE, WIDTH - EDGE)
    h, body = (HEIGHT - EDGE - 24) / max(len(quantiles), 1), []
    for k, (s, (a, b, m, c, d)) in enumerate(sorted(quantiles.items())):
        mid = 24 + (k + 0.5) * h
        body.append(f'<line x1="{x(a):.1f}" x2="{x(d):.1f}" y1="{mid:.1f}" y2="{mid:.1f}" stroke="black"/><rect x="{x(b):.1f}" y="{mid - h / 4:.1f}" width="{max(x(c) - x(b), 1):.1f}" height="{h / 2:.1f}" fill="{colour(k)}"/><line x1="{x(m):.1f}" x2="{x(m):.1f}" y1="{mid - h / 4:.1f}" y2="{mid + h / 4:.1f}" stroke="black"/><text x="{EDGE - 4}" y="{mid + 4:.1f}" text-anchor="end">{s}</text>')
    return _frame(title, "".join(body), x, None, (x_label, "State"))


def scatter_chart(xs: list[float], ys: list[float], title: str, x_label: str, y_label: str, groups: list[int] | None = None) -> str:
    x, y = _axes(xs, ys)
    dots = "".join(f'<circle cx="{x(a):.1f}" cy="{y(b):.1f}" r="3" fill="{colour(g)}"/>' for a, b, g in zip(xs, ys, groups or [0] * len(xs), strict=True) if a is not None and b is not None)
    return _frame(title, dots, x, y, (x_label, y_label))


def pareto_front(trials: list[dict], objectives: tuple[str, str], lower_is_better: tuple[bool, bool] = (True, True)) -> list[dict]:
    """Trials that no other is as good as in both objectives and better in one; those without a value take no part."""
    value = lambda t: tuple(t[o] if low else -t[o] for o, low in zip(objectives, lower_is_better, strict=True))
    best, out = math.inf, []
    whole = sorted((t for t in trials if all(t.get(o) is not None for o in objectives)), key=value)
    for t in whole:
        if value(t)[1] < best or (out and value(out[-1]) == value(t)):
            out.append(t)
            best = min(best, value(t)[1])
    return out


def pareto_tradeoff_chart(trials: list[dict], objectives: tuple[str, str], title: str = "Trade-off", **how) -> str:
    kept = [t for t in trials if all(t.get(o) is not None for o in objectives)]
    front = pareto_front(trials, objectives, **how)
    x, y = _axes([t[objectives[0]] for t in kept], [t[objectives[1]] for t in kept])
    dots = "".join(f'<circle cx="{x(t[objectives[0]]):.1f}" cy="{y(t[objectives[1]]):.1f}" r="3" fill="{colour(5 if t in front else 7)}"/>' for t in kept)
    ordered = sorted(front, key=lambda t: t[objectives[0]])
    return _frame(title, dots + _path([t[objectives[0]] for t in ordered], [t[objectives[1]] for t in ordered], x, y, 5), x, y, objectives)
