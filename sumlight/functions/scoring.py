"""Scoring functions: how raw scores become similarities, and similarities become terms of the sum.

A new one is a Scoring with two functions of columns; with the same two for numpy arrays as well, sums over all items are
worked out in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scoring:
    """name; metric, euclid or dot; the similarity of a raw score; the term of (sim, max, param); grid for test data."""

    name: str
    metric: str
    sim: Callable[[Column], Column]
    term: Callable[[Column, Column, Column], Column]
    params: tuple[float, ...] = ()
    sim_sql: str = ""
    term_sql: str = ""
    #: For arrays. Where terms depend on max, they must be such that term(s, m, p) = term(s, n, p) * term(n, m, p).
    array_sim: Callable[[np.ndarray], np.ndarray] | None = None
    array_term: Callable[[np.ndarray, float, float], np.ndarray] | None = None
    by_max: bool = True
    #: Of similarities, their greatest and an array of parameters: each parameter's sum of terms. None: term by term.
    array_sums: Callable[[np.ndarray, float, np.ndarray], np.ndarray] | None = None

    def sums(self, sim: np.ndarray, top: float, params: np.ndarray) -> np.ndarray:
        if self.array_sums:
            return self.array_sums(sim, top, params)
        return np.array([self.array_term(sim, top, p).sum() for p in params.tolist()])


def _exp_sums(sim: np.ndarray, top: float, params: np.ndarray, scale: Callable[[float], float]) -> np.ndarray:
    below, room, out = sim - top, np.empty(len(sim)), np.empty(len(params))
    for i, p in enumerate(params.tolist()):
        np.divide(below, scale(p), out=room)
        out[i] = np.exp(room, out=room).sum()
    return out


def _ball_sums(sim: np.ndarray, top: float, params: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.sort(np.abs(sim)), params, side="right").astype(float)


KDE = Scoring("kde", "euclid", lambda d: -d * d, lambda s, m, p: F.exp((s - m) / (F.lit(2.0) * p * p)), (0.25, 0.5, 1.0), "-(dist * dist)", "exp((sim - mx) / (2.0::double * param * param))", lambda d: -d * d, lambda s, m, p: np.exp((s - m) / (2.0 * p * p)), True, lambda s, m, p: _exp_sums(s, m, p, lambda p: 2.0 * p * p))
SOFTMAX = Scoring("softmax", "dot", lambda d: d, lambda s, m, p: F.exp((s - m) / p), (0.05, 0.1, 1.0), "dot", "exp((sim - mx) / param)", lambda d: d, lambda s, m, p: np.exp((s - m) / p), True, lambda s, m, p: _exp_sums(s, m, p, lambda p: p))
BALL = Scoring("ball", "euclid", lambda d: -d, lambda s, m, p: (F.abs(s) <= p).cast("double"), (1.2, 1.3, 1.4), "-dist", "(case when abs(sim) <= param then 1.0 else 0.0 end)::double", lambda d: -d, lambda s, m, p: (np.abs(s) <= p).astype(float), False, _ball_sums)
ALL = {s.name: s for s in (KDE, SOFTMAX, BALL)}


def powers(begin: float, end: float, step: float) -> list[float]:
    """10 ** p for p from begin up to end, without it."""
    return [float(10.0**p) for p in np.arange(begin, end, step)]


#: Parameter grids by setting; those of ball counting are unions of a coarse and a fine range.
GRIDS = {
    "image_kde": powers(-0.25, 1.75, 0.05),
    "image_softmax": powers(-3, 1, 0.1),
    "image_ball": sorted({*powers(-3, 2, 0.1), *powers(0.5, 1.8, 0.05)}),
    "text_kde": powers(-0.7, 1.5, 0.05),
    "text_ball": sorted({*powers(-5, 1, 0.1), *powers(0, 1.8, 0.05)}),
}


#: The settings of the experiment: a scoring function and its grid.
SETTINGS = {name: (ALL[name.split("_")[1]], tuple(grid)) for name, grid in GRIDS.items()}
