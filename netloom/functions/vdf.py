"""Volume-delay functions and their derivatives as column expressions; users may register more."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vdf:
    """value and slope take (flow, capacity, free-flow time, *parameters); they are built from `ops`, so that the same
    formula serves columns and numpy arrays. Flow of zero or less: the time and the slope are the free-flow time."""

    name: str
    parameters: tuple[str, ...]
    bounds: tuple[tuple[float, float], ...]
    formula: Callable
    gradient: Callable

    def value(self, flow: Column, capacity: Column, t0: Column, *p: Column | float) -> Column:
        return F.when(flow <= 0, t0).otherwise(self.formula(SPARK, flow, capacity, t0, *p))

    def slope(self, flow: Column, capacity: Column, t0: Column, *p: Column | float) -> Column:
        return F.when(flow <= 0, t0).otherwise(self.gradient(SPARK, flow, capacity, t0, *p))

    def values(self, flow: np.ndarray, capacity: np.ndarray, t0: np.ndarray, *p) -> np.ndarray:
        return np.where(flow <= 0, t0, self.formula(NUMPY, np.maximum(flow, 0), capacity, t0, *p))

    def slopes(self, flow: np.ndarray, capacity: np.ndarray, t0: np.ndarray, *p) -> np.ndarray:
        safe = np.where(flow <= 0, 1.0, flow)
        return np.where(flow <= 0, t0, self.gradient(NUMPY, safe, capacity, t0, *p))

    def check(self, *p: float) -> None:
        if len(p) != len(self.parameters):
            raise ValueError(f"{self.name} takes {', '.join(self.parameters)}")
        for name, value, (low, high) in zip(self.parameters, p, self.bounds, strict=True):
            if isinstance(value, int | float) and not low <= value <= high:
                raise ValueError(f"{name} of {self.name} must be within [{low}, {high}]")


class SPARK:
    pow = staticmethod(lambda x, y: F.pow(x, y if isinstance(y, Column) else F.lit(y)))
    sqrt = staticmethod(F.sqrt)
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))


class NUMPY:
    pow, sqrt, where = staticmethod(np.power), staticmethod(np.sqrt), staticmethod(np.where)


def _bpr(o, v, c, t, alpha, beta):
    return t * (1 + alpha * o.pow(v / c, beta))


def _bpr_slope(o, v, c, t, alpha, beta):
    return t * alpha * beta * o.pow(v / c, beta - 1) / c


def _bpr2(o, v, c, t, alpha, beta):
    x = v / c
    return t * (1 + alpha * o.where(x > 1, o.pow(x, 2 * beta), o.pow(x, beta)))


def _bpr2_slope(o, v, c, t, alpha, beta):
    x = v / c
    return t * alpha * o.where(x > 1, 2 * beta * o.pow(x, 2 * beta - 1), beta * o.pow(x, beta - 1)) / c


def _conical(o, v, c, t, alpha, beta):
    gap = 1 - v / c
    return t * (o.sqrt(alpha * alpha * gap * gap + beta * beta) - alpha * gap - beta + 2)


def _conical_slope(o, v, c, t, alpha, beta):
    gap = 1 - v / c
    return t * (alpha / c - alpha * alpha * gap / (c * o.sqrt(alpha * alpha * gap * gap + beta * beta)))


def _inrets(o, v, c, t, alpha):
    x = v / c
    return o.where(x <= 1, t * (1.1 - alpha * x) / (1.1 - o.where(x <= 1, x, x * 0)), t * ((1.1 - alpha) / 0.1) * x * x)


def _inrets_slope(o, v, c, t, alpha):
    x = v / c
    room = 11 * c - 10 * o.where(x <= 1, v, v * 0)
    return o.where(x <= 1, t * -110 * (alpha - 1) * c / (room * room), t * -20 * (alpha - 1.1) * v / (c * c))


def _akcelik(o, v, c, t, alpha, tau):
    z = v / c - 1
    return t + alpha * (z + o.sqrt(z * z + tau * (v / c) / c))


def _akcelik_slope(o, v, c, t, alpha, tau):
    z = v / c - 1
    return alpha * (1 / c + (2 * z / c + tau / (c * c)) / (2 * o.sqrt(z * z + tau * (v / c) / c)))


INF = float("inf")
REGISTRY: dict[str, Vdf] = {}


def register(vdf: Vdf) -> Vdf:
    REGISTRY[vdf.name] = vdf
    return vdf


for _f in (
    Vdf("bpr", ("alpha", "beta"), ((0, INF), (1, INF)), _bpr, _bpr_slope),
    Vdf("bpr2", ("alpha", "beta"), ((0, INF), (1, INF)), _bpr2, _bpr2_slope),
    Vdf("conical", ("alpha", "beta"), ((1, INF), (1, INF)), _conical, _conical_slope),
    Vdf("inrets", ("alpha",), ((0, 1),), _inrets, _inrets_slope),
    Vdf("akcelik", ("alpha", "tau"), ((0, INF), (0, INF)), _akcelik, _akcelik_slope),
):
    register(_f)


def vdf(name: str) -> Vdf:
    """By name, in any case."""
    try:
        return REGISTRY[name.lower()]
    except KeyError:
        raise ValueError(f"no volume-delay function {name!r}; there are {', '.join(sorted(REGISTRY))}") from None
