"""Reports of a reduction: Gini analysis, feature report as JSON and CSV, their zip, a summary."""

from __future__ import annotations

import io
import json
import math
import os
import zipfile
from datetime import datetime, timezone

from ..sources import tables
from .reduce import Reduction

VERSION = "1.0"
# The names of the reports' fields and columns, here and below.
STAGES = ("missing", "gini", "correlation")
CSV_HEAD = "feature,status,dropped_at_stage,reason,missing_ratio,gini,iv,feature_type,max_correlation,measure,drop_reason,correlated_with"


def clean(x):
    """JSON values: infinities are null, minus zero is zero."""
    if isinstance(x, float):
        return None if math.isinf(x) or math.isnan(x) else x + 0.0
    if isinstance(x, dict):
        return {k: clean(v) for k, v in x.items()}
    return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x


def _bins(r: Reduction) -> dict[str, dict]:
    """Bins by feature: at most some tens of rows for each."""
    out: dict[str, dict] = {}
    stat = lambda b: {"events": b.events, "non_events": b.non_events, "woe": b.woe, "iv_contribution": b.iv, "count": b["count"], "population_pct": b.population_pct, "event_rate": b.event_rate}
    new = lambda f: out.setdefault(f, {"bins": [], "categories": [], "missing_bin": None})
    for b in r.iv.numeric.orderBy("feature", "bin").collect() if r.iv.numeric else ():
        new(b.feature)["bins"].append({"lower_bound": b.lower, "upper_bound": b.upper} | stat(b))
    for b in r.iv.categorical.orderBy("feature", "woe", "category").collect() if r.iv.categorical else ():
        grouped = r.config.strategy == "cart" and not b.is_other
        new(b.feature)["categories"].append(({"categories": b.categories} if grouped else {"category": b.category}) | stat(b))
    for b in r.iv.missing.collect() if r.iv.missing else ():
        new(b.feature)["missing_bin"] = stat(b)
    return out


def gini_report(r: Reduction, input_file: str = "", *, legacy: bool = False):
    """Every analysed feature with its bins; legacy: the bare list."""
    c, bins, gone = r.config, _bins(r), set(r.of_stage("gini"))
    features = [{"feature_name": f, "feature_type": kind, **bins.get(f, {"bins": [], "categories": [], "missing_bin": None}), "iv": iv, "gini": gini} for f, (kind, iv, gini) in r.features.items()]
    if legacy:
        return clean(features)
    n = max(1, len(features))
    meta = {"timestamp": datetime.now(timezone.utc).isoformat(), "engine_version": VERSION, "input_file": input_file, "target_column": c.target, "binning_strategy": c.strategy, "num_bins": c.num_bins, "gini_threshold": c.gini_threshold, "min_category_samples": c.min_category_samples}
    if c.weight:
        meta["weight_column"] = c.weight
    if c.strategy == "cart" and c.cart_min_bin_pct is not None:
        meta["cart_min_bin_pct"] = c.cart_min_bin_pct
    kinds = [x["feature_type"] for x in features]
    summary = {"total_features_analyzed": len(features), "numeric_features": kinds.count("Numeric"), "categorical_features": kinds.count("Categorical"), "features_dropped": len(gone), "features_kept": len(features) - len(gone), "avg_iv": sum(x["iv"] for x in features) / n, "avg_gini": sum(x["gini"] for x in features) / n}
    return clean({"metadata": meta, "summary": summary, "features": [x | {"dropped": x["feature_name"] in gone} for x in features]})


def reduction_report(r: Reduction, input_file: str = "", output_file: str = "") -> dict:
    """A record for each feature: kept ones first, then by stage, then by name."""
    c = r.config
    where = {f: (stage, why) for f, stage, why in r.dropped}
    partners: dict[str, list] = {}
    for p in r.pairs:
        for a, b in ((p.feature1, p.feature2), (p.feature2, p.feature1)):
            partners.setdefault(a, []).append({"feature": b, "correlation": p.correlation, "measure": p.measure})
    records = []
    for f in r.initial:
        if f in (c.target, c.weight):
            continue
        stage, why = where.get(f, (None, None))
        record: dict = {"name": f, "status": "dropped" if stage else "kept"}
        if stage:
            record |= {"dropped_at_stage": stage, "reason": why}
        parts: dict = {}
        if f in r.missing:
            parts["missing"] = {"ratio": r.missing[f], "threshold": c.missing_threshold, "passed": stage != "missing"}
        if f in r.features:
            kind, iv, gini = r.features[f]
            parts["gini"] = {"gini": gini, "iv": iv, "threshold": c.gini_threshold, "passed": stage != "gini", "feature_type": kind}
        if stage not in ("missing", "gini"):
            all_ = sorted(partners.get(f, []), key=lambda e: -abs(e["correlation"]))
            parts["correlation"] = {"max_correlation": all_[0]["correlation"] if all_ else None, "correlated_with": all_[0]["feature"] if all_ else None, "threshold": c.correlation_threshold, "passed": stage != "correlation", "all_correlations": all_, "drop_reason": why if stage == "correlation" else None}
        records.append(record | {"analysis": parts})
    rank = {None: 0, "missing": 1, "gini": 2, "correlation": 3}
    records.sort(key=lambda x: (rank[x.get("dropped_at_stage")], x["name"]))
    at = {"missing": c.missing_threshold, "gini": c.gini_threshold, "correlation": c.correlation_threshold}
    ms = {f"{s}_ms": round(1000 * r.seconds.get(s, 0)) for s in ("load", *STAGES, "save")}
    return clean({
        "metadata": {"timestamp": datetime.now(timezone.utc).isoformat(), "engine_version": VERSION, "input_file": input_file, "output_file": output_file, "thresholds": {"missing_ratio": c.missing_threshold, "gini": c.gini_threshold, "correlation": c.correlation_threshold}, "settings": {"target_column": c.target, "weight_column": c.weight, "binning_strategy": c.strategy, "num_bins": c.num_bins}},
        "summary": {"initial_features": len(r.initial), "final_features": len(r.initial) - len(r.dropped), "dropped_count": len(r.dropped), "by_stage": {s: {"dropped": len(r.of_stage(s)), "threshold_used": at[s]} for s in STAGES}, "timing": ms | {"total_ms": sum(ms.values())}},
        "features": records,
    })


def escaped(text: str) -> str:
    """A CSV field: quoted if it holds a comma, quote or line end, or could be taken for a formula."""
    if any(c in text for c in ',"\n') or text[:1] in ("=", "+", "-", "@", "\t", "\r"):
        return '"' + text.replace('"', '""') + '"'
    return text


def csv_report(report: dict) -> str:
    number = lambda x: "" if x is None else f"{x:.4f}"
    lines = [CSV_HEAD]
    for x in report["features"]:
        a = x["analysis"]
        m, g, k = a.get("missing", {}), a.get("gini", {}), a.get("correlation", {})
        partners = [f"{e['feature']}: {e['correlation']:.4f} ({e['measure']})" for e in k.get("all_correlations", [])]
        listed = " | ".join(partners)
        if len(partners) > 1 or "," in listed:
            listed = '"' + listed.replace('"', '""') + '"'
        first = k["all_correlations"][0]["measure"] if partners else ""
        lines.append(",".join([escaped(x["name"]), x["status"], x.get("dropped_at_stage") or "", escaped(x.get("reason") or ""), number(m.get("ratio")), number(g.get("gini")), number(g.get("iv")), g.get("feature_type", ""), number(k.get("max_correlation")), first, escaped(k.get("drop_reason") or ""), listed]))
    return "\n".join(lines) + "\n"


def package(r: Reduction, output_file: str, input_file: str = "") -> str:
    """Three reports in one zip beside the output, wherever that is; nothing else stays."""
    stem = os.path.splitext(output_file)[0]
    report = reduction_report(r, input_file, output_file)
    files = {
        f"{stem}_gini_analysis.json": json.dumps(gini_report(r, input_file), indent=2),
        f"{stem}_reduction_report.json": json.dumps(report, indent=2),
        f"{stem}_reduction_report.csv": csv_report(report),
    }
    path, made = f"{stem}_reduction_report.zip", io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            info = zipfile.ZipInfo(os.path.basename(name))
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    tables.put(path, made.getvalue())
    return path


def summary(r: Reduction) -> str:
    n, gone = len(r.initial), len(r.dropped)
    lines = [f"features before: {n}", *(f"dropped by {s}: {len(r.of_stage(s))} ({r.seconds.get(s, 0):.1f} s)" for s in STAGES), f"features after: {n - gone}", f"reduction: {100 * gone / max(1, n):.1f} %", f"total: {sum(r.seconds.values()):.1f} s"]
    return "\n".join(lines)
