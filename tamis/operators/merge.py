"""Merging pre-bins: exact optimum by dynamic programming, or greedily. At most some tens of rows a feature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import SolverConfig
from ..functions.woe import SMOOTHING
from ..session import workers_import


def woe_iv(e: float, n: float, big_e: float, big_n: float) -> tuple[float, float]:
    a, b = (e + SMOOTHING) / (big_e + SMOOTHING), (n + SMOOTHING) / (big_n + SMOOTHING)
    w = math.log(a / b)
    return w, (a - b) * w


def greedy_runs(e: list[float], n: list[float], k: int, big_e: float, big_n: float) -> list[int]:
    """Lengths of the runs left after merging the neighbours that lose least IV until k are left."""
    runs = [[a, b, 1] for a, b in zip(e, n, strict=True)]
    value = lambda r: woe_iv(r[0], r[1], big_e, big_n)[1]
    while len(runs) > max(1, k):
        losses = [value(a) + value(b) - value([a[0] + b[0], a[1] + b[1]]) for a, b in zip(runs, runs[1:], strict=False)]
        i = losses.index(min(losses))
        runs[i : i + 2] = [[x + y for x, y in zip(runs[i], runs[i + 1], strict=True)]]
    return [r[2] for r in runs]


def optimal_runs(e: list[float], n: list[float], k: int, big_e: float, big_n: float, order: str = "none", least: float = 5.0) -> list[int] | None:
    """Lengths of exactly k runs of greatest total IV, each of weighted count ``least`` or more; None if there are none.

    order: none, or ascending or descending WoE from run to run (equal allowed).
    """
    m = len(e)
    if m <= k:
        return [1] * m
    ce, cn = np.concatenate(([0], np.cumsum(e))), np.concatenate(([0], np.cumsum(n)))
    stat = {}
    for i in range(m):
        for j in range(i, m):
            a, b = ce[j + 1] - ce[i], cn[j + 1] - cn[i]
            if a + b >= least:
                stat[i, j] = woe_iv(a, b, big_e, big_n)
    # best[i, j]: (total, start of the run before) over partitions whose last run is i..j
    best = {(0, j): (stat[0, j][1], None) for j in range(m) if (0, j) in stat}
    trail = [best]
    for _ in range(1, k):
        step = {}
        for (i, j), (w, v) in stat.items():
            top = None
            for h in range(i):
                before = best.get((h, i - 1))
                if before is None:
                    continue
                was = stat[h, i - 1][0]
                if order == "ascending" and w < was or order == "descending" and w > was:
                    continue
                if top is None or before[0] + v > top[0]:
                    top = (before[0] + v, h)
            if top is not None:
                step[i, j] = top
        best = step
        trail.append(best)
    ends = [(v[0], -i) for (i, j), v in best.items() if j == m - 1]
    if not ends:
        return None
    i, j, runs = -max(ends)[1], m - 1, []
    for level in reversed(trail):
        runs.append(j - i + 1)
        h = level[i, j][1]
        if h is not None:
            i, j = h, i - 1
    return runs[::-1]


def runs_of(e, n, k: int, big_e: float, big_n: float, solver: SolverConfig | None) -> list[int]:
    if len(e) <= k:
        return [1] * len(e)
    found = None
    if solver is not None:
        # peak and valley put no constraint, and auto takes the best of all kinds, which is none
        order = solver.monotonicity if solver.monotonicity in ("ascending", "descending") else "none"
        found = optimal_runs(e, n, k, big_e, big_n, order, solver.min_bin_samples)
    return found if found is not None else greedy_runs(e, n, k, big_e, big_n)


def merged(prebins: DataFrame, num_bins: int, big_e: float, big_n: float, solver: SolverConfig | None) -> DataFrame:
    """Bins of the same columns: runs of neighbouring pre-bins are joined, outer bounds stay."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin", kind="stable")
        runs = runs_of(g["events"].tolist(), g["non_events"].tolist(), num_bins, big_e, big_n, solver)
        own = np.repeat(np.arange(len(runs)), runs)
        out = g.groupby(own).agg(feature=("feature", "first"), lower=("lower", "first"), upper=("upper", "last"), events=("events", "sum"), non_events=("non_events", "sum"))
        return out.assign(bin=np.arange(len(runs), dtype=np.int32))[["feature", "bin", "lower", "upper", "events", "non_events"]]

    workers_import(prebins.sparkSession)
    return prebins.groupBy("feature").applyInPandas(kernel, "feature string, bin int, lower double, upper double, events double, non_events double")
