"""What a user's own parts must offer to take the place of the engine's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame


@runtime_checkable
class Metrics(Protocol):
    """Predictions and a context to numbers by name."""

    def __call__(self, predictions: DataFrame, context: dict) -> dict[str, float]: ...


@runtime_checkable
class Transformer(Protocol):
    def fit(self, df: DataFrame) -> Transformer: ...

    def transform(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Forecaster(Protocol):
    def fit(self, df: DataFrame, target: str) -> Forecaster: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Distribution(Protocol):
    def logpdf(self, x: np.ndarray) -> np.ndarray: ...

    def cdf(self, x: np.ndarray) -> np.ndarray: ...

    def ppf(self, q: np.ndarray) -> np.ndarray: ...


@runtime_checkable
class Detector(Protocol):
    """Scores and boundaries of an ordered series; ``changepoint.DETECTORS`` takes any."""

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]: ...


@runtime_checkable
class Embedder(Protocol):
    def encode(self, values: Sequence) -> np.ndarray: ...


@runtime_checkable
class Mapper(Protocol):
    def map(self, function: Callable, items: Iterable) -> Iterator: ...


@runtime_checkable
class Tracker(Protocol):
    def log_metrics(self, metrics: dict[str, float]) -> None: ...

    def log_json(self, name: str, value: object) -> object: ...


class Unsupported(NotImplementedError):
    """A model has no such operation."""


class PanelModel:
    """A model over a panel. A subclass says what it can; the rest is Unsupported."""

    def fit(self, df: DataFrame) -> PanelModel:
        raise Unsupported("fit")

    def predict(self, df: DataFrame) -> DataFrame:
        raise Unsupported("predict")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        raise Unsupported("predict_proba")

    def filter(self, df: DataFrame) -> DataFrame:
        raise Unsupported("filter")

    def smooth(self, df: DataFrame) -> DataFrame:
        raise Unsupported("smooth")

    def transition_matrix(self) -> np.ndarray:
        raise Unsupported("transition_matrix")

    def state_statistics(self) -> dict:
        raise Unsupported("state_statistics")
