"""All models by name: what they are, what they take, and one way to run them on a panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import changepoint, rules
from tessera.operators.models import density, hmm, other


@dataclass(frozen=True)
class Spec:
    """One model. ``defaults`` are all parameters that it takes; ``run``: frame, features, parameters to the frame with ``state``."""

    name: str
    family: str
    run: Callable[[DataFrame, list[str], dict], DataFrame]
    defaults: dict = field(default_factory=dict)
    filters: bool = False
    needs_labels: bool = False


@dataclass(frozen=True)
class Model:
    spec: Spec
    parameters: dict

    def run(self, df: DataFrame, features: list[str]) -> DataFrame:
        return self.spec.run(df, features, self.parameters)

    @property
    def configuration(self) -> dict:
        return {"model": self.spec.name, "family": self.spec.family} | self.parameters


def _hmm(name: str) -> Spec:
    defaults = {k: v for k, v in asdict(hmm.VARIANTS[name]).items()}

    def run(df, features, p):
        return hmm.run_series(df, features, hmm.Config(**p | {"inputs": tuple(p["inputs"])}))

    return Spec(name, "econometric" if name.startswith("markov") else "probabilistic", run, defaults, filters=True)


def _series(name: str, family: str, label: Callable, **defaults) -> Spec:
    return Spec(name, family, lambda df, features, p: other.per_series(df, features, lambda x: label(x, **p)), defaults)


def _detector(name: str, **defaults) -> Spec:
    def run(df, features, p):
        found = changepoint.detect(df, name, features[0], **p)
        return found.withColumn("state", F.col("segment").cast("int"))

    return Spec(name.replace("_", "-"), "changepoint", run, defaults)


def _rule(name: str) -> Spec:
    t = rules.DEFAULTS[name]
    return Spec(f"{name.replace('_', '-')}-rule", "rule", lambda df, features, p: rules.default_rule(name, features[0], p["threshold"]).predict(df), {"threshold": t.value})


def _supervised(method: str, name: str) -> Spec:
    def run(df, features, p):
        model = other.supervised(df, features, p["label"], method)
        return other.classify(model, df, features).withColumn("state", F.col("prediction").cast("int"))

    return Spec(name, "supervised", run, {"label": "y"}, needs_labels=True)


def _latent(x: np.ndarray, **p) -> np.ndarray:
    return other.switching_lds(x, **p).argmax(1)


SPECS: dict[str, Spec] = {s.name: s for s in [
    *map(_hmm, hmm.VARIANTS),
    Spec("markov-switching-garch", "econometric", lambda df, f, p: hmm.run_series(other.garch_features(df, f[0]), [f[0], "ret2", "ret_abs"], hmm.Config(**p)), {"states": 2, "iterations": 50, "restarts": 3}, filters=True),
    Spec("markov-switching-har", "econometric", lambda df, f, p: hmm.run_series(other.har_features(df, f[0]), ["rv", "rv5", "rv22"], hmm.Config(**p)), {"states": 2, "iterations": 50, "restarts": 3}, filters=True),
    Spec("kmeans", "clustering", lambda df, f, p: other.kmeans_regimes(df, f, **p), {"k": 2, "seeds": 3, "seed": 0}),
    Spec("gaussian-mixture", "clustering", lambda df, f, p: other.mixture_regimes(df, f, **p), {"k": 2, "seed": 0}),
    _series("hierarchical", "clustering", other.hierarchical, k=2, linkage="ward"),
    _series("hdbscan", "clustering", density.density_states, least=5, k=2, seed=0),
    _series("jump-penalized-kmeans", "clustering", other.jump_segmentation, k=2, penalty=5.0, seed=0),
    _series("ticc", "clustering", lambda x, **p: other.ticc(x, **p)[0], k=2, window=5, penalty=5.0, lasso=0.01, seed=0),
    _series("jump-segmentation", "segmentation", other.jump_segmentation, k=2, penalty=5.0, seed=0, gaussian=True),
    _series("switching-kalman", "state-space", _latent, k=2, seed=0),
    _series("switching-lds", "state-space", _latent, k=2, seed=0),
    _series("switching-dynamic-factor", "state-space", _latent, k=2, seed=0, factors=1),
    _series("recurrent-switching-lds", "state-space", lambda x, **p: _latent(x, recurrent=np.zeros((p["k"], x.shape[1])), **p), k=2, seed=0),
    _series("explicit-duration-switching-lds", "state-space", _latent, k=2, seed=0),
    _series("threshold-autoregression", "econometric", lambda x, **p: other.threshold_autoregression(x[:, 0], **p)[0], k=2, order=1),
    Spec("smooth-transition-autoregression", "econometric", lambda df, f, p: other.smooth_transition(df, f[0], p["slope"]).withColumn("state", (F.col("weight") >= 0.5).cast("int")), {"slope": 5.0}),
    Spec("switching-correlation", "econometric", lambda df, f, p: other.switching_correlation(df, f, **p), {"k": 2, "window": 21}),
    Spec("switching-copula", "econometric", lambda df, f, p: other.switching_correlation(df, f, ranks=True, **p), {"k": 2, "window": 21}),
    Spec("switching-volatility", "econometric", lambda df, f, p: other.switching_volatility(df, f[0], **p), {"k": 2}),
    *(_detector(n, **d) for n, d in {"cusum": {"threshold": 5.0, "drift": 0.0, "least": 5}, "page_hinkley": {"threshold": 50.0, "delta": 0.005, "alpha": 0.999, "least": 5}, "binary_segmentation": {"most": 5, "least": 5, "threshold": 1.0}, "pelt": {"penalty": 3.0, "least": 5}, "distributional": {"window": 20, "threshold": 0.75, "kernel": True}, "bocpd": {"hazard": 0.01, "threshold": 0.5, "least": 5, "short": 0}}.items()),
    *map(_rule, rules.DEFAULTS),
    _supervised("logistic", "logistic-classifier"), _supervised("random_forest", "random-forest-classifier"), _supervised("gradient_boosting", "gradient-boosting-classifier"),
    Spec("transition-hazard", "supervised", lambda df, f, p: other.hazard(df, f, p["label"], p["horizon"]).withColumn("state", (F.col("hazard") >= 0.5).cast("int")), {"label": "state", "horizon": 1}, needs_labels=True),
]}
#: Known by name only: nobody has an estimator for them here.
ABSENT = ("hdp-hmm", "switching-jump-diffusion")


def available(family: str | None = None) -> list[str]:
    return sorted(n for n, s in SPECS.items() if family in (None, s.family))


def spec(name: str) -> Spec:
    if name in ABSENT:
        raise NotImplementedError(f"{name} is not built")
    if name not in SPECS:
        near = [n for n in SPECS if name.split("-")[0] in n]
        raise KeyError(f"no model {name}" + (f"; perhaps {', '.join(sorted(near))}" if near else ""))
    return SPECS[name]


def configuration(name: str, parameters: dict | None = None) -> dict:
    """The model's defaults with what is given; a parameter that it does not take is an error, and so is one of another type."""
    s, given = spec(name), parameters or {}
    if unknown := set(given) - set(s.defaults):
        raise ValueError(f"{name} takes no {', '.join(sorted(unknown))}")
    for k, v in given.items():
        d = s.defaults[k]
        if d is not None and v is not None and not isinstance(v, (type(d), int) if isinstance(d, float) else (type(d), list) if isinstance(d, tuple) else type(d)):
            raise ValueError(f"{name}: {k} is of {type(d).__name__}, not {type(v).__name__}")
    return s.defaults | given


def create(name: str, parameters: dict | None = None) -> Model:
    return Model(spec(name), configuration(name, parameters))


def describe(name: str) -> dict:
    s = spec(name)
    return {f.name: getattr(s, f.name) for f in fields(s) if f.name != "run"}
