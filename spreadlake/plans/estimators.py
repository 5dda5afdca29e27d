"""Hedge estimators by name, and the single back-test from bars to trades."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators import rolling, signals, trades
from ..operators.kalman import KalmanConfig, kalman

Estimator = Callable[[DataFrame], DataFrame]
_known: dict[str, Callable[..., Estimator]] = {}


def register(name: str) -> Callable:
    """Extension point: a factory (keys, order, **options) -> (aligned -> aligned with beta, spread, zscore)."""

    def add(factory: Callable[..., Estimator]) -> Callable[..., Estimator]:
        _known[name] = factory
        return factory

    return add


def create(name: str, keys: list[str], order: str = "bar_idx", **options) -> Estimator:
    if name not in _known:
        raise ValueError(f"unknown estimator {name}; known: {sorted(_known)}")
    return _known[name](keys, order, **options)


@register("ols_rolling")
def _ols(keys: list[str], order: str, window: int = 3300, z_window: int = 30, null_z: str = "null") -> Estimator:
    return lambda df: rolling.rolling_ols(df, window, z_window, keys, order, null_z, index="bar_idx" if order == "bar_idx" else None)


@register("kalman")
def _kalman(keys: list[str], order: str, **options) -> Estimator:
    return lambda df: kalman(df, keys, KalmanConfig(**options), order)


@dataclass
class Backtest:
    """A back-test in an explicit order of filters; each filter maps a frame with `signal` to one."""

    keys: list[str]
    estimator: Estimator
    entry: float = 2.0
    leave: float = 0.5
    stop: float = 4.0
    filters: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    order: str = "bar_idx"
    spec: dict = field(default_factory=lambda: dict(trades.SPEC))
    mark_open: bool = False
    dollar_stop: float = 0.0

    def signals(self, aligned: DataFrame) -> DataFrame:
        out = signals.state_machine(self.estimator(aligned), self.entry, self.leave, self.stop, self.keys, self.order)
        for f in self.filters:
            out = f(out)
        return out

    def run(self, aligned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(signals, trades, equity)."""
        s = self.signals(aligned)
        t = trades.backtest(s, self.keys, self.order, spec=self.spec, mark_open=self.mark_open, dollar_stop=self.dollar_stop)
        return s, t, trades.equity(s, t, self.keys, order=self.order, spec=self.spec)


def gate(allowed: Column, keys: list[str], order: str = "bar_idx") -> Callable[[DataFrame], DataFrame]:
    return lambda df: signals.entry_filter(df, allowed, keys, order)
