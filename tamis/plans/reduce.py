"""The reduction: missing share, then IV and Gini, then association; each on what the last one left."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReduceConfig
from ..functions.woe import quoted
from ..operators import analysis, association, missing, target


@dataclass
class Reduction:
    config: ReduceConfig
    initial: list[str]
    missing: dict[str, float] = field(default_factory=dict)
    dropped: list[tuple[str, str, str]] = field(default_factory=list)
    iv: analysis.IvResult | None = None
    features: dict[str, tuple[str, float, float]] = field(default_factory=dict)
    pairs: list[association.Pair] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    data: DataFrame | None = None

    def of_stage(self, stage: str) -> list[str]:
        return [f for f, s, _ in self.dropped if s == stage]


def reduced(df: DataFrame, c: ReduceConfig, *, ties: list[str] | None = None, on_progress: Callable[[str, str, str], None] | None = None) -> Reduction:
    """Runs all stages; data is df without the dropped columns, its target values as they were."""
    df = df.drop(*c.drop_columns)
    out = Reduction(c, df.columns)
    weight = target.weight_of(df, c.weight)
    if c.event is None:
        target.validate_binary(df, c.target)
    rows = df.withColumns({"__y": target.target_mask(df, c.target, c.event, c.non_event), "__w": weight}).persist()
    try:
        return _stages(df, rows, c, out, ties or [], on_progress or (lambda *a: None))
    finally:
        rows.unpersist()


def _stages(df: DataFrame, rows: DataFrame, c: ReduceConfig, out: Reduction, ties: list[str], tell: Callable[[str, str, str], None]) -> Reduction:
    """rows is df with __y and __w, cached."""

    def stage(name: str, drops: list[tuple[str, str]], began: float) -> None:
        nonlocal rows, df
        out.dropped += [(f, name, why) for f, why in drops]
        df, rows = (x.drop(*[f for f, _ in drops]) for x in (df, rows))
        out.seconds[name] = time.time() - began
        tell(name, "done", f"{len(drops)} dropped")

    began = time.time()
    tell("missing", "start", "")
    ratios = missing.missing_ratios(rows, F.col("__w"), c.weight).where("feature not in ('__y', '__w')")
    out.missing = {r.feature: r.missing_ratio for r in ratios.collect()}
    high = [f for f, r in out.missing.items() if r > c.missing_threshold and f != c.target]
    stage("missing", [(f, f"Missing ratio {out.missing[f]:.4f} > threshold {c.missing_threshold:.4f}") for f in high], began)
    began = time.time()
    tell("gini", "start", "")
    out.iv = analysis.analyze_features(rows, c, ties=ties)
    found = out.iv.features.collect()
    out.features = {r.feature: (r.feature_type, r.iv, r.gini) for r in found}
    low = [r for r in found if abs(r.gini) < c.gini_threshold]
    stage("gini", [(r.feature, f"Gini {r.gini:.4f} < threshold {c.gini_threshold:.4f}") for r in low], began)
    began = time.time()
    tell("correlation", "start", "")
    text = [f for f, (kind, _, _) in out.features.items() if kind == "Categorical"]
    out.pairs = association.associated_pairs(rows, c.correlation_threshold, F.col("__w"), (c.weight,), text)
    known = {f: association.Metadata(v[1], out.missing.get(f)) for f, v in out.features.items()}
    stage("correlation", association.features_to_drop(out.pairs, c.target, known), began)
    out.data = df.select(*[quoted(x) for x in df.columns])
    return out
