"""Exponential smoothing recurrences over many series at once.

The recurrence is sequential in time, so it can not be a set operation. Spark deals the
series to tasks as arrays; inside a task NumPy advances all series of a block and all
smoothing weights together, one day at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

BLOCK = 128


def _blocks(values: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(series x days) matrices padded with NaN, and their lengths."""
    for start in range(0, len(values), BLOCK):
        part = [np.asarray(v, dtype=float) for v in values.iloc[start : start + BLOCK]]
        size = np.array([len(v) for v in part])
        grid = np.full((len(part), max(size.max(initial=0), 1)), np.nan)
        for i, v in enumerate(part):
            grid[i, : len(v)] = v
        yield grid, size


def ses_path(y: np.ndarray, size: np.ndarray, alphas: np.ndarray):
    """Final level and squared error sum for every series and weight."""
    level = np.repeat(y[:, :1], len(alphas), axis=1)
    sse = np.zeros_like(level)
    for t in range(1, y.shape[1]):
        live = (t < size)[:, None]
        err = np.where(live, y[:, t : t + 1] - level, 0.0)
        sse += err * err
        level = level + alphas * err
    return level, sse


def best_ses(alphas: Sequence[float]) -> Callable:
    """UDF: array of values -> weight with the least squared error, and its level."""
    grid = np.asarray(alphas, dtype=float)

    @F.pandas_udf("a double, l double")
    def fit(values: pd.Series) -> pd.DataFrame:
        weight, final = [], []
        for y, size in _blocks(values):
            level, sse = ses_path(y, size, grid)
            pick = np.argmin(sse, axis=1)
            weight.append(grid[pick])
            final.append(level[np.arange(len(pick)), pick])
        return pd.DataFrame({"a": np.concatenate(weight), "l": np.concatenate(final)})

    return fit


def _aicc(sse: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    n = n[:, None].astype(float)
    spare = n - k - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        score = n * np.log(np.maximum(sse / n, 1e-12)) + 2.0 * k + 2.0 * k * (k + 1) / spare
    return np.where(spare > 0, score, np.inf)


def additive_path(
    y: np.ndarray, size: np.ndarray, m: int, weights: np.ndarray, trend: bool, season: bool
):
    """Additive-error smoothing for every row of ``weights`` (level, trend, season).

    Starts from the first season's mean, the slope between the first two seasons and the
    first season's deviations; returns level, slope, next season's terms and error sums.
    """
    s, g = y.shape[0], len(weights)
    first = y[:, :m].mean(axis=1)
    slope0 = (y[:, m : 2 * m].mean(axis=1) - first) / m if trend else np.zeros(s)
    level = np.repeat((first - slope0 * ((m + 1) / 2.0))[:, None], g, axis=1)
    slope = np.repeat(slope0[:, None], g, axis=1)
    cycle = np.zeros((m, s, g))
    if season:
        cycle += (y[:, :m] - first[:, None]).T[:, :, None]
    sse = np.zeros((s, g))
    a, b, c = weights[:, 0], weights[:, 1], weights[:, 2]
    for t in range(y.shape[1]):
        live = (t < size)[:, None]
        place = t % m
        err = y[:, t : t + 1] - level - slope - cycle[place]
        err = np.where(live, err, 0.0)
        level = np.where(live, level + slope, level) + a * err
        slope = slope + b * err
        if season:
            cycle[place] += c * err
        sse += err * err
    turn = size % m
    order = (turn[:, None] + np.arange(m)) % m
    ahead = cycle[order, np.arange(s)[:, None]]  # series x season x weights
    return level, slope, ahead, sse


def _grid(*axes: Sequence[float]) -> np.ndarray:
    mesh = np.array(np.meshgrid(*axes, indexing="ij"), dtype=float)
    flat = mesh.reshape(len(axes), -1).T
    return np.hstack([flat, np.zeros((len(flat), 3 - len(axes)))])


ETS_TYPE = "kind string, l double, b double, s array<double>"


def best_ets(
    m: int, alphas: Sequence[float], betas: Sequence[float], gammas: Sequence[float]
) -> Callable:
    """UDF: array of values -> the family member and weights with the least AICc.

    A series shorter than two seasons only gets level smoothing from its first value.
    """
    members = [
        ("ANN", 3, _grid(alphas), False, False),
        ("AAN", 5, _grid(alphas, betas), True, False),
        ("AAA", 5 + m, _grid(alphas, betas, gammas), True, True),
    ]

    def one_block(y: np.ndarray, size: np.ndarray) -> list[tuple]:
        out: list[tuple] = [None] * len(size)
        long = size >= 2 * m
        for i in np.flatnonzero(~long):
            own = y[i : i + 1, : size[i]]
            level, sse = ses_path(own, size[i : i + 1], np.asarray(alphas, dtype=float))
            out[i] = ("ANN", float(level[0, np.argmin(sse[0])]), 0.0, [0.0] * m)
        if not long.any():
            return out
        rows = np.flatnonzero(long)
        y, size = y[rows], size[rows]
        best = np.full(len(rows), np.inf)
        for kind, k, weights, trend, season in members:
            level, slope, ahead, sse = additive_path(y, size, m, weights, trend, season)
            score = _aicc(sse, size, k)
            pick = np.argmin(score, axis=1)
            value = score[np.arange(len(rows)), pick]
            for j in np.flatnonzero((value < best) | (kind == "ANN")):
                p = pick[j]
                out[rows[j]] = (
                    kind, float(level[j, p]), float(slope[j, p]), ahead[j, :, p].tolist()
                )
            best = np.minimum(best, value)
        return out

    @F.pandas_udf(ETS_TYPE)
    def fit(values: pd.Series) -> pd.DataFrame:
        rows = [r for y, size in _blocks(values) for r in one_block(y, size)]
        return pd.DataFrame(rows, columns=["kind", "l", "b", "s"])

    return fit
