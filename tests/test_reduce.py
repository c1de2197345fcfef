import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tamis.config import ReduceConfig, SolverConfig
from tamis.operators import analysis, association, binning, histogram, merge, missing, sampling, target
from tamis.plans import reports
from tamis.plans.reduce import reduced
from tamis.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_woe_and_iv_of_a_known_bin():
    w, iv = merge.woe_iv(8, 0, 8, 12)
    assert w == pytest.approx(3.2188758248682006) and iv == pytest.approx(3.0901207918734723)


def test_missing_ratio_and_strict_threshold(spark):
    df = frame(spark, [(1, 1.0, None, 0), (2, None, None, 1), (3, 3.0, None, 0), (4, 4.0, 1.0, 1), (5, 5.0, None, 0)], "id int, a double, b double, y int")
    got = {r.feature: r.missing_ratio for r in missing.missing_ratios(df).collect()}
    assert got == {"id": 0.0, "a": pytest.approx(0.2), "b": pytest.approx(0.8), "y": 0.0}
    assert [r.feature for r in missing.above_threshold(missing.missing_ratios(df), 0.8, "y").collect()] == []
    assert missing.missing_ratios(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="Total weight is zero"):
        missing.missing_ratios(df, F.lit(0.0)).collect()


def test_targets_and_weights(spark):
    df = frame(spark, [("G", 1.0), ("B", None), (None, 2.0), ("X", 0.0)], "t string, w double")
    assert target.analyze_target(df, "t").labels == ["B", "G", "X"]
    assert tuple(target.mapped_counts(df, "t", "B", "G").first()) == (1, 1, 2)
    assert df.agg(F.sum(target.weight_of(df, "w"))).first()[0] == 4.0
    with pytest.raises(ValueError, match="negative"):
        target.weight_of(df.withColumn("w", F.lit(-1.0)), "w")
    numbers = frame(spark, [(1.0,), (2.0,), (2.5,)], "t double")
    assert target.analyze_target(numbers, "t").labels == ["1", "2", "2.5"]


def brute_runs(e, n, k, least, order):
    m, best = len(e), None
    for cuts in itertools.combinations(range(1, m), k - 1):
        at = [0, *cuts, m]
        parts = [(sum(e[a:b]), sum(n[a:b])) for a, b in zip(at, at[1:])]
        if any(x + y < least for x, y in parts):
            continue
        stat = [merge.woe_iv(x, y, sum(e), sum(n)) for x, y in parts]
        if order == "ascending" and any(a[0] > b[0] for a, b in zip(stat, stat[1:])):
            continue
        total = sum(s[1] for s in stat)
        best = total if best is None else max(best, total)
    return best


@pytest.mark.parametrize("order", ["none", "ascending"])
def test_optimal_merge_against_enumeration(order):
    rng = random.Random(3)
    for _ in range(60):
        m, k = rng.randint(3, 8), rng.randint(2, 3)
        e, n = [rng.randint(0, 9) for _ in range(m)], [rng.randint(1, 9) for _ in range(m)]
        runs = merge.optimal_runs(e, n, k, sum(e), sum(n), order) if m > k else None
        want = brute_runs(e, n, k, 5, order) if m > k else None
        if runs is None:
            assert want is None
            continue
        at = [0, *itertools.accumulate(runs)]
        assert len(runs) == k and sum(merge.woe_iv(sum(e[a:b]), sum(n[a:b]), sum(e), sum(n))[1] for a, b in zip(at, at[1:])) == pytest.approx(want)


def row_cart(rows, budget, least):
    """Split values by plain recursion over sorted (value, y) rows."""
    def g(p):
        t = len(p)
        q = sum(y for _, y in p) / t if t else 0
        return 2 * q * (1 - q)

    if budget <= 0 or len(rows) < 2 * least:
        return []
    best = (0, None)
    for i in range(least, len(rows) - least + 1):
        if i < len(rows) and i > 0 and rows[i][0] != rows[i - 1][0]:
            a, b = rows[:i], rows[i:]
            gain = round(g(rows) - len(a) / len(rows) * g(a) - len(b) / len(rows) * g(b), 12)
            if gain > best[0]:
                best = (gain, i)
    if best[1] is None:
        return []
    i, rest = best[1], budget - 1
    return [*row_cart(rows[:i], rest // 2, least), rows[i][0], *row_cart(rows[i:], rest - rest // 2, least)]


def test_cart_against_recursion(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 60)), int(rng.random() < 0.5)) for _ in range(300)]
    df = target.prepared(frame(spark, rows, "x double, y int"), "y", None, None, None)
    got = binning.cart_prebins(histogram.histogram(df, ["x"], "double"), 8, 10).orderBy("bin").collect()
    want = row_cart(sorted(rows), 7, 10)
    assert [b.lower for b in got] == [min(r[0] for r in rows), *sorted(want)] and got[-1].upper == math.inf


def test_auc_of_perfect_and_tied_scores(spark):
    df = frame(spark, [("p", 1.0, 0.0, 5.0), ("p", 2.0, 5.0, 0.0), ("t", 1.0, 5.0, 5.0), ("n", 1.0, 0.0, 5.0)], "feature string, score double, events double, non_events double")
    assert {r.feature: r.auc for r in analysis.auc(df).collect()} == {"p": 1.0, "t": 0.5, "n": 0.5}


def test_known_associations(spark):
    cells = [("x", "p")] * 30 + [("x", "q")] * 10 + [("y", "p")] * 10 + [("y", "q")] * 30
    v = association.cramers_v_pairs(frame(spark, cells, "a string, b string"), ["a", "b"]).first().v
    assert v == pytest.approx(0.4902, abs=1e-3)
    df = frame(spark, [(c, x) for c, x in (("a", 1.0), ("b", 5.0), ("c", 10.0)) for _ in range(3)], "c string, x double")
    assert association.eta_pairs(df, ["c"], ["x"]).first().eta == pytest.approx(1.0)
    big = frame(spark, [(i * 1e10, 3.7 * i * 1e10 + 1e10, 5.0) for i in range(20)], "a double, b double, k double")
    assert association.pearson_pairs(big, ["a", "b", "k"]) == [("a", "b", pytest.approx(1.0))]


def test_waterfall():
    P, M = association.Pair, association.Metadata
    pairs = [P("a", "b", 0.98, "Pearson"), P("a", "c", 0.97, "Pearson"), P("b", "c", 0.96, "Pearson")]
    assert [f for f, _ in association.features_to_drop(pairs, "t")] == ["b", "c"]
    assert association.features_to_drop([P("t", "x", -0.9, "Pearson")], "t") == [("x", "Correlated with target (Pearson -0.9000); dropped to protect target")]
    assert association.features_to_drop(pairs[:1], "t", {"a": M(0.1), "b": M(0.2)}) == [("a", "Correlated with b (Pearson 0.9800); lower IV (0.1000 vs 0.2000)")]
    assert association.features_to_drop(pairs[:1], "t", {"a": M(None, 0.3), "b": M(None, 0.2)})[0][1].endswith("higher missing ratio (0.3000 vs 0.2000)")


def test_whole_reduction_and_reports(spark, tmp_path):
    rows = [(i % 2, float(i % 2) * 10 + i * 0.1, None if i > 3 else 1.0, 5.0, "u" if i % 2 else "v", i) for i in range(40)]
    df = frame(spark, rows, "target int, good double, gap double, flat double, kind string, `odd.name` int")
    for strategy in ("cart", "quantile"):
        r = reduced(df, ReduceConfig("target", strategy=strategy), ties=["odd.name"])
        assert r.of_stage("missing") == ["gap"] and "flat" in r.of_stage("gini") and "target" in r.data.columns
        assert {"good", "kind"} <= set(r.of_stage("correlation"))
    report = reports.reduction_report(r)
    assert report["summary"]["dropped_count"] == len(r.dropped)
    text = reports.csv_report(report)
    assert text.startswith(reports.CSV_HEAD) and len(text.splitlines()) == 6
    path = reports.package(r, str(tmp_path / "out.parquet"))
    import zipfile

    assert len(zipfile.ZipFile(path).namelist()) == 3
    assert reports.escaped("=1") == '"=1"' and reports.escaped('a"b') == '"a""b"'
    one = reduced(df.withColumn("target", F.when(F.col("`odd.name`") < 20, "g").otherwise("b")), ReduceConfig("target", "b", "g", solver=SolverConfig("asc")))
    assert one.data.select("target").distinct().count() == 2


def test_sampling(spark):
    df = frame(spark, [("North" if i < 30 else "South" if i < 55 else None, i) for i in range(100)], "region string, v int")
    assert [tuple(r) for r in sampling.strata(df, "region").collect()] == [("(null)", 45), ("North", 30), ("South", 25)]
    s = sampling.stratified_sample(df, "region", {"North": 5, "(null)": 9})
    assert sorted((r.region or "", r.sampling_weight) for r in s.collect()) == [("", 5.0)] * 9 + [("North", 6.0)] * 5
    assert sampling.random_sample(df, fraction=0.1, seed=1).collect() == sampling.random_sample(df, fraction=0.1, seed=1).collect()
    assert sampling.equal_allocation_sample(df, "region", 4).count() == 12
    for bad in (lambda: sampling.random_sample(df, 101), lambda: sampling.equal_allocation_sample(df, "region", 26), lambda: sampling.random_sample(df.withColumn("sampling_weight", F.lit(1)), 1), lambda: sampling.random_sample(df, fraction=1.0)):
        with pytest.raises(ValueError):
            bad()


def test_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c\n1,2.5,x\n,3.5,\n3,,z\n")
    df = tables.read(spark, str(p))
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "string"} and df.where("c is null").count() == 1
    out = tables.convert(spark, str(p))
    assert tables.parquet_rows(spark, out) == 3 and tables.column_names(spark, out) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="csv, parquet, sas7bdat"):
        tables.kind_of("x.xls")


def test_csv_cells(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b\n1,"x, ""y""\nz"\n2,w\n')
    assert [tuple(r) for r in tables.read(spark, str(p)).collect()] == [(1, 'x, "y"\nz'), (2, "w")]
    p.write_text("a,b\n" + "1,x\n" * 50 + "oops,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read(spark, str(p), 10).collect()
    assert tables.read(spark, str(p), 10, bad_cells="null").where("a is null").count() == 1
    with pytest.raises(Exception, match="(?i)not exist|not_found"):
        tables.read(spark, str(tmp_path / "none.csv"))
    out = str(tmp_path / "one.parquet")
    tables.write(spark.range(100).repartition(5), out, single_file=True)
    import os

    assert os.path.isfile(out) and spark.read.parquet(out).count() == 100 and not os.path.exists(out + ".parts")


def brute_chunks(rows, prebins):
    rows, out = sorted(rows), []
    size = -(-len(rows) // prebins)
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        out.append((min(r[0] for r in part), sum(r[2] for r in part), sum(1 - r[2] for r in part)))
    return out


@pytest.mark.parametrize("ties", [["id"], []])
def test_quantile_bins_of_equal_values(spark, ties):
    rng = random.Random(8)
    rows = [(0.0 if rng.random() < 0.95 else float(rng.randint(-3, 9)), i, int(rng.random() < 0.4)) for i in range(1003)]
    df = target.prepared(frame(spark, rows, "x double, id int, y int"), "y", None, None, None).repartition(5)
    hist = histogram.histogram(df, ["x"], "double")
    got = binning.quantile_prebins(hist, histogram.long_form(df, ["x"], "double", *ties), 20, ties).orderBy("bin").collect()
    want = brute_chunks(rows if ties else [(x, y, y) for x, _, y in rows], 20)
    assert [(b.lower, b.events, b.non_events) for b in got] == want
    assert got[-1].upper == math.inf and [b.upper for b in got[:-1]] == [b.lower for b in got[1:]]


def test_correlation_of_many_columns(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 40)) + 1e6 * np.arange(40)
    x[:, 1] = 2 * x[:, 0] + 5
    x[:, 2] = 7.0
    gone = rng.random(x.shape) < 0.1
    w = rng.integers(0, 3, 300).astype(float)
    names = [f"c{i}" for i in range(40)]
    df = frame(spark, [(*(None if g else float(v) for v, g in zip(r, m)), float(q)) for r, m, q in zip(x, gone, w)], ", ".join(f"{c} double" for c in names) + ", w double").repartition(4)
    for block in (400, 7):
        monkeypatch.setattr(association, "BLOCK", block)
        m = association.correlation_matrix(df, names, F.col("w"))
        for i in range(40):
            for j in range(i):
                on = ~gone[:, i] & ~gone[:, j] & (w > 0)
                a, b, q = x[on, i], x[on, j], w[on]
                a, b = a - np.average(a, weights=q), b - np.average(b, weights=q)
                if j == 2 or i == 2:
                    assert np.isnan(m[i, j])
                else:
                    assert abs(m[i, j] - (q * a * b).sum() / math.sqrt((q * a * a).sum() * (q * b * b).sum())) < 1e-9
    assert association.matrix_pairs(m, names, 0.9) == [("c0", "c1", pytest.approx(1.0))]
    odd = frame(spark, [(1.0, 2.0), (2.0, float("nan")), (3.0, 4.0)], "a double, b double")
    assert math.isnan(association.pearson_pairs(odd, ["a", "b"])[0][2])


def test_zero_weights_and_many_categories(spark):
    df = frame(spark, [(1.0, 2.0, 1.0), (99.0, -5.0, 0.0), (2.0, 4.0, 1.0), (-7.0, 50.0, 0.0), (3.0, 6.0, 1.0)], "a double, b double, w double")
    assert association.pearson_pairs(df, ["a", "b"], F.col("w")) == [("a", "b", pytest.approx(1.0))]
    for n, there in ((100, True), (101, False)):
        df = frame(spark, [(f"k{i % n}", "x" if i % 2 else "y", float(i % n)) for i in range(4 * n)], "c string, d string, v double")
        got = association.associated_pairs(df, 0.5)
        assert any("c" in (p.feature1, p.feature2) for p in got) == there


def test_samples_of_equal_rows(spark):
    df = frame(spark, [("a", 1)] * 70 + [("a", 2)] * 20 + [("b", 1)] * 10, "s string, v int").repartition(4)
    for n in (1, 35, 69, 71, 100):
        assert sampling.random_sample(df, n).count() == n
    got = sampling.stratified_sample(df, "s", {"a": 80, "b": 10})
    assert sorted((r.s, r.n) for r in got.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()) == [("a", 80), ("b", 10)]
    whole = {(r.s, r.v): r.n for r in df.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(r.n <= whole[r.s, r.v] for r in got.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).collect())
    same = [sorted(map(tuple, sampling.random_sample(spark.range(5000).repartition(k), 400, seed=3).collect())) for k in (2, 7)]
    assert same[0] == same[1] and len(set(same[0])) == 400


def test_decimals_are_numbers(spark):
    import decimal

    df = frame(spark, [(i % 2, decimal.Decimal(i % 2 * 10 + i), i % 3 == 0) for i in range(40)], "y int, d decimal(10,2), b boolean")
    with pytest.warns(UserWarning, match="not analysed: b"):
        r = reduced(df, ReduceConfig("y", correlation_threshold=1.0))
    assert set(r.features) == {"d"}
