"""Command line: reduce, sample, convert."""

from __future__ import annotations

import argparse
import time

from .config import ReduceConfig, SolverConfig
from .operators import sampling
from .plans import reports
from .plans.reduce import reduced
from .session import session
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamis", description=__doc__)
    sub = p.add_subparsers(dest="task", required=True)
    r = sub.add_parser("reduce")
    r.add_argument("--input", "-i", required=True)
    r.add_argument("--target", "-t", required=True)
    r.add_argument("--output", "-o")
    r.add_argument("--event-value")
    r.add_argument("--non-event-value")
    r.add_argument("--weight-column", "-w")
    r.add_argument("--missing-threshold", type=float, default=0.3)
    r.add_argument("--correlation-threshold", type=float, default=0.4)
    r.add_argument("--gini-threshold", type=float, default=0.05)
    r.add_argument("--gini-bins", type=int, default=10)
    r.add_argument("--prebins", type=int, default=20)
    r.add_argument("--binning-strategy", default="cart")
    r.add_argument("--use-solver", action=argparse.BooleanOptionalAction, default=True)
    r.add_argument("--monotonicity", default="none")
    r.add_argument("--solver-timeout", type=float, default=30)
    r.add_argument("--solver-gap", type=float, default=0.01)
    r.add_argument("--min-category-samples", type=int, default=5)
    r.add_argument("--cart-min-bin-pct", type=float, default=5.0)
    r.add_argument("--drop-columns", default="", type=lambda s: tuple(x.strip() for x in s.split(",") if x.strip()))
    r.add_argument("--infer-schema-length", type=int, default=tables.INFER_ROWS)
    # taken for compatibility: there are no questions to leave out
    r.add_argument("--manual", action="store_true")
    r.add_argument("--no-confirm", action="store_true")
    s = sub.add_parser("sample")
    s.add_argument("input")
    s.add_argument("--output", "-o")
    s.add_argument("--method", "-m", choices=("random", "stratified", "equal"), default="random")
    s.add_argument("--count", "-n", type=int)
    s.add_argument("--fraction", "-f", type=float)
    s.add_argument("--strata-column")
    s.add_argument("--strata-sizes")
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--infer-schema-length", type=int, default=tables.INFER_ROWS)
    c = sub.add_parser("convert")
    c.add_argument("input")
    c.add_argument("output", nargs="?")
    c.add_argument("--infer-schema-length", type=int, default=tables.INFER_ROWS)
    c.add_argument("--fast", action="store_true")
    for x in (r, s):
        x.add_argument("--single-file", action="store_true", help="write one file instead of a folder of parts")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    if a.task == "convert":
        print(tables.convert(spark, a.input, a.output, a.infer_schema_length, fast=a.fast))
        return
    began = time.time()
    df = tables.read(spark, a.input, a.infer_schema_length)
    if a.task == "sample":
        if a.count is not None and a.fraction is not None:
            raise SystemExit("--count and --fraction exclude each other")
        if a.method == "random":
            out = sampling.random_sample(df, a.count, a.fraction, a.seed)
        elif not a.strata_column:
            raise SystemExit("strata_column is required for Stratified / EqualAllocation sampling")
        elif a.method == "stratified":
            out = sampling.stratified_sample(df, a.strata_column, sampling.parsed_sizes(a.strata_sizes or ""), a.seed)
        else:
            out = sampling.equal_allocation_sample(df, a.strata_column, a.count, a.fraction, a.seed)
        tables.write(out, a.output or tables.output_path(a.input, "sampled"), single_file=a.single_file)
        return
    config = ReduceConfig(a.target, a.event_value, a.non_event_value, a.weight_column, a.missing_threshold, a.gini_threshold, a.correlation_threshold, a.gini_bins, a.prebins, a.binning_strategy, a.min_category_samples, a.cart_min_bin_pct, a.use_solver, SolverConfig(a.monotonicity, a.solver_timeout, a.solver_gap), a.drop_columns)
    loaded = time.time() - began
    r = reduced(df, config)
    r.seconds["load"] = loaded
    path, began = a.output or tables.output_path(a.input, "reduced"), time.time()
    tables.write(r.data, path, single_file=a.single_file)
    r.seconds["save"] = time.time() - began
    print(reports.summary(r))
    print(reports.package(r, path, a.input))


if __name__ == "__main__":
    main()
