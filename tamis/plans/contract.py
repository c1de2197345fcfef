"""Queries over the driver's tables, with their SQL. Doubles are rounded alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ReduceConfig, SolverConfig
from ..functions.woe import bin_statistics, gini_impurity, left_out, numeric_columns, text_columns
from ..operators import analysis, association, binning, histogram, merge, missing, sampling, target
from ..sources import sas7bdat_write, tables
from . import oracles
from .reduce import reduced
from .reports import csv_report, gini_report, reduction_report, summary

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TIES = ["l_orderkey", "l_linenumber"]
CART, QUANTILE = ReduceConfig("l_returnflag", "R", "N"), ReduceConfig("l_returnflag", "R", "N", strategy="quantile")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, *names: str) -> DataFrame:
    """Doubles rounded, minus zero made zero."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if kinds[c] == "double" and (not names or c in names) else F.col(c) for c in df.columns])


def lineitem(spark: SparkSession, sf_dir: str, weight: str | None = None) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select(*LINE, *TIES, "l_returnflag", "l_linestatus")
    return target.prepared(df, "l_returnflag", "R", "N", weight)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_gini(spark, sf_dir)


# ---- stage 1


def missing_ratio(spark, sf_dir):
    return rounded(missing.missing_ratios(labelled(spark, sf_dir)))


def missing_ratio_weighted(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return rounded(missing.missing_ratios(df, target.weight_of(df, "n_chars"), "n_chars"))


def missing_drop(spark, sf_dir):
    return rounded(missing.above_threshold(missing.missing_ratios(labelled(spark, sf_dir)), 0.3, "toxic"))


# ---- targets and weights


def target_labels(spark, sf_dir):
    return target.labels(read(spark, sf_dir, "orders"), "o_orderstatus")


def target_mask_counts(spark, sf_dir):
    return target.mapped_counts(read(spark, sf_dir, "orders"), "o_orderstatus", "F", "O")


def target_is_binary(spark, sf_dir):
    a = [(c, target.analyze_target(read(spark, sf_dir, t), c).already_binary) for t, c in (("labels", "toxic"), ("labels", "quality"), ("orders", "o_orderstatus"))]
    return spark.createDataFrame(a, "target string, already_binary boolean")


def weights_clean(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("w", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    w = target.weight_of(df, "w")
    return rounded(df.agg(F.sum(w).alias("total_weight"), F.count(w).alias("n_rows")), 2)


# ---- histograms and bins


def woe_by_category(spark, sf_dir):
    df = target.prepared(read(spark, sf_dir, "orders"), "o_orderstatus", "F", "O", None)
    t = analysis.totals(df)
    hist = histogram.histogram(df, ["o_orderpriority"], "string")
    return rounded(bin_statistics(analysis.with_totals(hist, t)).select(F.col("value").alias("category"), "events", "non_events", "woe", "iv", "count", "population_pct", "event_rate"))


def woe_rare_other(spark, sf_dir):
    df = read(spark, sf_dir, "part").withColumn("y", (F.col("p_size") > 25).cast("int"))
    df = target.prepared(df.select("p_name", "y"), "y", None, None, None)
    t = analysis.totals(df)
    cats = analysis.folded(histogram.histogram(df, ["p_name"], "string"), 30)
    return rounded(bin_statistics(analysis.with_totals(cats, t)).select("category", "rows", "events", "non_events", "woe", "iv"))


def missing_bin_woe(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("y", (F.col("n_chars") > 1000).cast("int"))
    df = target.prepared(df, "y", None, None, None)
    hist = histogram.histogram(df, ["quality"], "double")
    return rounded(analysis.missing_bins(hist, analysis.totals(df)).select("feature", "events", "non_events", "woe", "iv"))


def iv_categorical(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("band", F.concat(F.lit("q"), F.ceil(F.col("l_quantity") / 5).cast("string")))
    r = analysis.analyze_features(df.select("l_linestatus", "band", "l_returnflag", "__y", "__w"), QUANTILE)
    return rounded(r.features.drop("gini", "feature_type"))


def gini_categorical(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("band", F.concat(F.lit("q"), F.ceil(F.col("l_quantity") / 5).cast("string")))
    r = analysis.analyze_features(df.select("l_linestatus", "band", "l_returnflag", "__y", "__w"), QUANTILE)
    return rounded(r.features.drop("iv", "feature_type"))


def _prebins(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    with histogram.kept(histogram.histogram(df, LINE, "double")) as (hist,):
        return binning.quantile_prebins(hist, histogram.long_form(df, LINE, "double", *TIES), 20, TIES)


def quantile_prebins(spark, sf_dir):
    finite = F.when(F.col("upper") < float("inf"), F.col("upper"))
    return rounded(_prebins(spark, sf_dir).withColumn("upper", finite))


def _quantile_bins(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    t = analysis.totals(df)
    return df, t, bin_statistics(analysis.with_totals(_prebins(spark, sf_dir), t))


def quantile_iv(spark, sf_dir):
    return rounded(_quantile_bins(spark, sf_dir)[2].groupBy("feature").agg(F.sum("iv").alias("iv")))


def quantile_gini(spark, sf_dir):
    df, _, bins = _quantile_bins(spark, sf_dir)
    return rounded(analysis.gini_of(analysis.encoded(histogram.histogram(df, LINE, "double"), bins)))


def gini_impurity_by_quantity(spark, sf_dir):
    hist = histogram.histogram(lineitem(spark, sf_dir), ["l_quantity"], "double")
    return rounded(hist.select("value", gini_impurity(F.col("events"), F.col("non_events")).alias("impurity")))


def best_split(spark, sf_dir):
    hist = histogram.histogram(lineitem(spark, sf_dir), LINE, "double")
    with histogram.with_running(hist, ["value"], ["events", "non_events", "rows"]) as running:
        tops = [binning.Node(r.feature, -binning.INF, binning.INF, (0.0, 0.0, 0), (r.e, r.n, r.r), 1) for r in running.groupBy("feature").agg(F.sum("events").alias("e"), F.sum("non_events").alias("n"), F.sum("rows").alias("r")).collect()]
        found = histogram.small(binning.best_splits(running, tops, 5))
    return found.select("feature", F.round("value", 6).alias("value"), F.round("gain", 9).alias("gain"), F.col("lr").cast("long").alias("rows_left"))


def cart_bins(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    pre = binning.cart_prebins(histogram.histogram(df, LINE, "double"), 20, binning.min_rows(df.count(), 5.0))
    return rounded(pre.withColumn("upper", F.when(F.col("upper") < float("inf"), F.col("upper"))))


def cart_iv(spark, sf_dir):
    r = analysis.analyze_features(lineitem(spark, sf_dir).select(*LINE, "l_returnflag", "__y", "__w"), CART)
    return rounded(r.features)


def categorical_cart_bins(spark, sf_dir):
    df = target.prepared(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderstatus", "F", "O", None)
    t = analysis.totals(df)
    c = ReduceConfig("o_orderstatus", "F", "O", num_bins=3)
    return rounded(analysis.categorical_features(df, ["o_orderpriority"], c, t)[1].select("feature", "category", "events", "non_events", "woe", "iv"))


def _merged(spark, sf_dir, solver):
    df = lineitem(spark, sf_dir)
    t = analysis.totals(df)
    out = merge.merged(_prebins(spark, sf_dir), 5, t.events, t.non_events, solver)
    return rounded(bin_statistics(analysis.with_totals(out, t)).select("feature", "bin", "lower", "events", "non_events", "woe", "iv"))


def greedy_merge(spark, sf_dir):
    return _merged(spark, sf_dir, None)


def optimal_merge(spark, sf_dir):
    return _merged(spark, sf_dir, SolverConfig())


def optimal_merge_ascending(spark, sf_dir):
    return _merged(spark, sf_dir, SolverConfig("ascending"))


def low_gini_features(spark, sf_dir):
    return analysis.low_gini(quantile_gini(spark, sf_dir), 0.5)


# ---- association


def _priced(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_linestatus")
    return df.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("band", F.concat(F.lit("b"), F.floor(F.col("l_extendedprice") / 20000).cast("string")))


def pearson_pairs(spark, sf_dir):
    got = association.pearson_pairs(_priced(spark, sf_dir), [*LINE, "revenue"])
    return rounded(spark.createDataFrame(got, "feature1 string, feature2 string, r double"), 6)


def pearson_weighted(spark, sf_dir):
    got = association.pearson_pairs(_priced(spark, sf_dir), ["l_extendedprice", "l_discount", "l_tax", "revenue"], F.col("l_quantity"))
    return rounded(spark.createDataFrame(got, "feature1 string, feature2 string, r double"), 6)


def cramers_v_pairs(spark, sf_dir):
    return rounded(association.cramers_v_pairs(_priced(spark, sf_dir), ["l_returnflag", "l_linestatus", "band"]))


def eta_pairs(spark, sf_dir):
    return rounded(association.eta_pairs(_priced(spark, sf_dir), ["l_returnflag", "band"], ["l_quantity", "revenue"]))


def associated(spark, sf_dir):
    got = association.associated_pairs(_priced(spark, sf_dir), 0.5)
    return rounded(spark.createDataFrame([(p.feature1, p.feature2, p.correlation, p.measure) for p in got], association.SCHEMA))


def _dropped(spark, sf_dir):
    df = _priced(spark, sf_dir).withColumn("y", (F.col("l_extendedprice") > 50000).cast("int"))
    return reduced(df, ReduceConfig("y", gini_threshold=0.02, correlation_threshold=0.9))


def drop_selection(spark, sf_dir):
    return spark.createDataFrame(_dropped(spark, sf_dir).dropped, "feature string, stage string, reason string")


def reduce_report(spark, sf_dir):
    report = reduction_report(_dropped(spark, sf_dir))
    return spark.createDataFrame([(x["name"], x["status"], x.get("dropped_at_stage")) for x in report["features"]], "feature string, status string, dropped_at_stage string")


# ---- sampling, sources


def strata_counts(spark, sf_dir):
    return sampling.strata(read(spark, sf_dir, "orders"), "o_orderpriority")


def sample_weights_stratified(spark, sf_dir):
    s = sampling.stratified_sample(read(spark, sf_dir, "orders"), "o_orderstatus", {"F": 100, "O": 50}, key=["o_orderkey"])
    return rounded(s.groupBy(F.col("o_orderstatus").alias("value"), "sampling_weight").agg(F.count(F.lit(1)).alias("n")))


def sample_weights_equal(spark, sf_dir):
    s = sampling.equal_allocation_sample(read(spark, sf_dir, "customer"), "c_mktsegment", 20, key=["c_custkey"])
    return rounded(s.groupBy(F.col("c_mktsegment").alias("value"), "sampling_weight").agg(F.count(F.lit(1)).alias("n")))


def sample_random_size(spark, sf_dir):
    s = sampling.random_sample(read(spark, sf_dir, "orders"), fraction=0.1, key=["o_orderkey"])
    return rounded(s.groupBy("sampling_weight").agg(F.count(F.lit(1)).alias("n")))


def schema_columns(spark, sf_dir):
    names = tables.column_names(spark, f"{sf_dir}/nation.parquet")
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


def parquet_row_count(spark, sf_dir):
    return spark.createDataFrame([(tables.parquet_rows(spark, f"{sf_dir}/lineitem.parquet"),)], "n long")


def _shared(spark: SparkSession) -> str:
    """A new path below the folder that all executors share; a local master may use this machine's."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}').rstrip('/')}/convert-{uuid.uuid4().hex}"


SOLD = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]


def convert_roundtrip(spark, sf_dir):
    """Parquet to CSV and back."""
    base = _shared(spark)
    tables.convert(spark, f"{sf_dir}/lineitem.parquet", f"{base}.csv")
    tables.convert(spark, f"{base}.csv", f"{base}-back.parquet")
    # whole numbers come back from text as the narrowest type that holds them
    return spark.read.parquet(f"{base}-back.parquet").select(*SOLD).withColumn("l_orderkey", F.col("l_orderkey").cast("long"))


def convert_by_extension(spark, sf_dir):
    """Any format to any other, fast: Parquet to Parquet to CSV."""
    base = _shared(spark)
    tables.convert(spark, f"{sf_dir}/orders.parquet", f"{base}.parquet", by_extension=True, fast=True)
    tables.convert(spark, f"{base}.parquet", f"{base}.csv", by_extension=True)
    return tables.read(spark, f"{base}.csv", 0).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice", "o_orderpriority")


def csv_quoted(spark, sf_dir):
    """Fields with commas, quotes and line ends, written to one file and read back."""
    path = f"{_shared(spark)}.csv"
    df = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('a "'), "p_name", F.lit('",\n'), "p_brand").alias("label"))
    tables.write(df, path, single_file=True)
    return tables.read(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


def table_stats(spark, sf_dir):
    found = [(t, tables.stats(read(spark, sf_dir, t))) for t in ("lineitem", "orders", "events")]
    return spark.createDataFrame([(t, x["rows"], x["columns"], x["mb"] > 0) for t, x in found], "name string, n_rows long, n_columns long, has_size boolean")


def target_preview(spark, sf_dir):
    """A projected, limited scan."""
    df = tables.target_preview(read(spark, sf_dir, "orders"), "o_orderstatus", 1_000)
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(",".join(df.columns)))


SAS_KINDS = {"sas_plain": {"wide": True, "mix": 3}, "sas_rle": {"compression": "rle"}, "sas_rdc": {"compression": "rdc", "order": ">", "wide": True}}


def _sas(spark, sf_dir, kind: str) -> str:
    """Customers as a SAS7BDAT file; every 7th balance is missing."""
    columns = [("c_custkey", 8, 1, ""), ("c_name", 24, 2, "$"), ("c_nationkey", 4, 1, "BEST"), ("c_acctbal", 8, 1, "COMMA"), ("day", 8, 1, "DATE"), ("at", 8, 1, "DATETIME")]
    day, at = F.expr("date_add(date'2001-02-03', cast(c_custkey % 1000 as int))"), F.expr("timestamp_ntz'2001-02-03 04:05:06' + make_dt_interval(0, 0, 0, c_custkey)")
    rows = read(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), day, at)
    path = f"{_shared(spark)}.sas7bdat"
    tables.put(path, sas7bdat_write.written(columns, map(tuple, rows.toLocalIterator()), **SAS_KINDS[kind]))
    return path


def _shown(df: DataFrame) -> DataFrame:
    """Dates and times as text."""
    return df.withColumns({"day": F.col("day").cast("string"), "at": F.col("at").cast("string")})


def sas_plain(spark, sf_dir):
    return _shown(tables.read(spark, _sas(spark, sf_dir, "sas_plain")))


def sas_rle(spark, sf_dir):
    return _shown(tables.read(spark, _sas(spark, sf_dir, "sas_rle")))


def sas_rdc(spark, sf_dir):
    return _shown(tables.read(spark, _sas(spark, sf_dir, "sas_rdc")))


def sas_to_parquet(spark, sf_dir):
    source = _sas(spark, sf_dir, "sas_plain")
    return _shown(spark.read.parquet(tables.convert(spark, source)))


def sas_columns(spark, sf_dir):
    path = _sas(spark, sf_dir, "sas_rle")
    kinds = dict(tables.read(spark, path).dtypes)
    return spark.createDataFrame([(k, c, kinds[c]) for k, c in enumerate(tables.column_names(spark, path))], "place int, name string, type string")


# ---- more of the reduction


def optimal_merge_descending(spark, sf_dir):
    return _merged(spark, sf_dir, SolverConfig("desc"))


def optimal_merge_auto(spark, sf_dir):
    """auto, peak and valley put no constraint."""
    return _merged(spark, sf_dir, SolverConfig("auto"))


def merge_of_few_bins(spark, sf_dir):
    """No more bins than asked for: they stay."""
    df = lineitem(spark, sf_dir)
    t = analysis.totals(df)
    out = merge.merged(_prebins(spark, sf_dir), 20, t.events, t.non_events, SolverConfig())
    return rounded(out.select("feature", "bin", "lower", "events", "non_events"))


def correlation_matrix(spark, sf_dir):
    names = [*LINE, "revenue"]
    m = association.correlation_matrix(_priced(spark, sf_dir), names)
    return rounded(spark.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "feature1 string, feature2 string, r double"))


def matrix_pairs(spark, sf_dir):
    names = [*LINE, "revenue"]
    got = association.matrix_pairs(association.correlation_matrix(_priced(spark, sf_dir), names), names, 0.1)
    return rounded(spark.createDataFrame(got, "feature1 string, feature2 string, r double"))


def column_kinds(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    found = [("numeric", c) for c in numeric_columns(df)] + [("text", c) for c in text_columns(df)] + [("other", c) for c in left_out(df)]
    return spark.createDataFrame(found, "kind string, name string")


def drop_columns(spark, sf_dir):
    """Columns dropped by name and by stage leave the others' values as they were."""
    df = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", (F.col("l_quantity") * 2).alias("twin"))
    r = reduced(df, ReduceConfig("l_linestatus", "O", "F", gini_threshold=0.0, correlation_threshold=0.9, drop_columns=("l_tax",)))
    return rounded(r.data.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.lit(",".join(r.data.columns)).alias("columns")))


def binary_targets(spark, sf_dir):
    """Which targets may be used without a mapping, and why the others may not."""
    out = []
    cases = [("labels", "toxic", None), ("orders", "o_orderstatus", None), ("lineitem", "l_linenumber", None), ("nation", "n_regionkey", "n_regionkey = 1")]
    for t, c, where in cases:
        df = read(spark, sf_dir, t)
        try:
            target.validate_binary(df.where(where) if where else df, c)
            out.append((c, "ok"))
        except ValueError as e:
            out.append((c, str(e).partition("' ")[2]))
    return spark.createDataFrame(out, "target string, told string")


def gini_report_features(spark, sf_dir):
    df = lineitem(spark, sf_dir).select(*LINE, "l_returnflag")
    r = reduced(df, ReduceConfig("l_returnflag", "R", "N", gini_threshold=0.0, correlation_threshold=1.0))
    report, bare = gini_report(r), gini_report(r, legacy=True)
    assert [x["feature_name"] for x in bare] == [x["feature_name"] for x in report["features"]] and report["summary"]["total_features_analyzed"] == len(bare)
    rows = [(x["feature_name"], x["feature_type"], len(x["bins"]), float(sum(b["events"] for b in x["bins"])), x["iv"], x["gini"]) for x in report["features"]]
    return rounded(spark.createDataFrame(rows, "feature string, feature_type string, n_bins long, events double, iv double, gini double"))


def csv_report_rows(spark, sf_dir):
    import csv
    import io

    rows = csv.DictReader(io.StringIO(csv_report(reduction_report(_dropped(spark, sf_dir)))))
    return spark.createDataFrame([(x["feature"], x["status"], x["dropped_at_stage"], x["reason"], x["missing_ratio"], x["gini"], x["iv"], x["feature_type"]) for x in rows], "feature string, status string, dropped_at_stage string, reason string, missing_ratio string, gini string, iv string, feature_type string")


def summary_lines(spark, sf_dir):
    lines = dict(x.split(": ") for x in summary(_dropped(spark, sf_dir)).splitlines())
    return spark.createDataFrame([(int(lines["features before"]), int(lines["features after"]), *(int(lines[f"dropped by {s}"].split()[0]) for s in ("missing", "gini", "correlation")))], "before int, after int, by_missing int, by_gini int, by_correlation int")


def waterfall(spark, sf_dir):
    """Which of planted pairs go, by every rule in turn."""
    P, M = association.Pair, association.Metadata
    pairs = [P("y", "a", 0.99, "Pearson"), P("b", "c", 0.98, "Eta"), P("d", "e", 0.97, "Pearson"), P("d", "f", 0.96, "Pearson"), P("g", "h", 0.95, "CramersV"), P("k", "j", 0.94, "Pearson"), P("c", "m", 0.93, "Pearson")]
    known = {"b": M(0.3, 0.0), "c": M(0.2, 0.0), "g": M(None, 0.1), "h": M(None, 0.2), "m": M(0.9, 0.0)}
    return spark.createDataFrame(association.features_to_drop(pairs, "y", known), "feature string, reason string")


def sample_parsed_sizes(spark, sf_dir):
    """Strata and sizes as the command line has them."""
    s = sampling.stratified_sample(read(spark, sf_dir, "orders"), "o_orderstatus", sampling.parsed_sizes("F:30, P:20,X:5"), key=["o_orderkey"])
    return rounded(s.groupBy(F.col("o_orderstatus").alias("value"), "sampling_weight").agg(F.count(F.lit(1)).alias("n")))


_NAMES = """missing_ratio missing_ratio_weighted missing_drop target_labels target_mask_counts target_is_binary weights_clean woe_by_category
woe_rare_other missing_bin_woe iv_categorical gini_categorical quantile_prebins quantile_iv quantile_gini gini_impurity_by_quantity best_split cart_bins
cart_iv categorical_cart_bins greedy_merge optimal_merge optimal_merge_ascending low_gini_features pearson_pairs pearson_weighted cramers_v_pairs eta_pairs
associated drop_selection reduce_report correlation_matrix matrix_pairs column_kinds drop_columns binary_targets gini_report_features csv_report_rows summary_lines waterfall
optimal_merge_descending optimal_merge_auto merge_of_few_bins strata_counts sample_parsed_sizes convert_by_extension csv_quoted table_stats target_preview sas_plain sas_rle sas_rdc sas_to_parquet sas_columns sample_weights_stratified sample_weights_equal sample_random_size schema_columns parquet_row_count convert_roundtrip""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ---- SQL

_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_RATIOS = "SELECT unnest([{names}]) AS feature, round(unnest([{sums}]), 6) + 0.0 AS missing_ratio FROM " + _LABELLED


def _ratios(names: list[str], w: str) -> str:
    return _RATIOS.format(names=", ".join(f"'{n}'" for n in names), sums=", ".join(f"sum(CASE WHEN {n} IS NULL THEN {w} ELSE 0.0 END) / sum({w})" for n in names))


_woe, _iv = oracles.woe, oracles.iv
_LINE = "line AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS y FROM lineitem WHERE l_returnflag IN ('R', 'N')), tot AS (SELECT sum(y)::DOUBLE AS E, sum(1 - y)::DOUBLE AS N FROM line)"
_LONG = _LINE + ", lng AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, y, l_orderkey, l_linenumber FROM line" for c in LINE) + ")"
_BINS = (
    _LONG
    + """, num AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, l_orderkey, l_linenumber, y) AS rn, count(*) OVER (PARTITION BY feature) AS cnt FROM lng),
pre AS (SELECT feature, CAST(floor((rn - 1) / ceil(cnt / 20.0)) AS INT) AS bin, min(value) AS lower, sum(y)::DOUBLE AS events, sum(1 - y)::DOUBLE AS non_events FROM num GROUP BY 1, 2),
bins AS (SELECT *, lead(lower) OVER (PARTITION BY feature ORDER BY bin) AS upper FROM pre)"""
)
_GINI = (
    _BINS
    + f""", scored AS (SELECT feature, bin, lower, round({_woe("events", "non_events")}, 10) AS woe FROM bins, tot),
hist AS (SELECT feature, value, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM lng GROUP BY 1, 2),
hit AS (SELECT h.feature, h.value, max(b.bin) AS bin FROM hist h JOIN scored b ON h.feature = b.feature AND b.lower <= h.value GROUP BY 1, 2),
g AS (SELECT h.feature, s.woe, sum(p) AS p, sum(q) AS q FROM hist h JOIN hit USING (feature, value) JOIN scored s ON s.feature = h.feature AND s.bin = hit.bin GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(p + q) OVER (PARTITION BY feature ORDER BY woe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
a AS (SELECT feature, (sum(p * (before + (p + q) / 2)) - sum(p) * sum(p) / 2) / (sum(p) * sum(q)) AS auc FROM r GROUP BY feature)"""
)
_BAND = _LINE.replace("SELECT *, CASE", "SELECT *, 'q' || CAST(ceil(l_quantity / 5) AS INT) AS band, CASE", 1)
_CATS = (
    _BAND
    + f""", cats AS (SELECT 'l_linestatus' AS feature, l_linestatus AS c, sum(y)::DOUBLE AS ev, sum(1 - y)::DOUBLE AS nev FROM line GROUP BY 2
UNION ALL SELECT 'band', band, sum(y)::DOUBLE, sum(1 - y)::DOUBLE FROM line GROUP BY 2),
w AS (SELECT feature, ev AS p, nev AS q, round({_woe("ev", "nev")}, 10) AS woe, {_iv("ev", "nev")} AS iv FROM cats, tot)"""
)
_PRICED = "t AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue, 'b' || CAST(floor(l_extendedprice / 20000) AS INT) AS band FROM lineitem)"


def _corr(a: str, b: str, w: str | None) -> str:
    if w is None:
        return f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) + 0.0 AS r FROM t"
    m = lambda x: f"(SELECT sum({w} * {x}) / sum({w}) FROM t)"
    return f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(sum({w} * ({a} - {m(a)}) * ({b} - {m(b)})) / sqrt(sum({w} * ({a} - {m(a)}) ^ 2) * sum({w} * ({b} - {m(b)}) ^ 2)), 6) + 0.0 AS r FROM t"


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _v(a: str, b: str, rounded: bool = True) -> str:
    start, end = ("round(", ", 6) + 0.0") if rounded else ("", "")
    return f"""SELECT '{a}' AS feature1, '{b}' AS feature2, {start}least(1.0, sqrt(greatest(0, (s - 1) - (r - 1) * (c - 1) / (n - 1)) / least(r - (r - 1) ^ 2 / (n - 1) - 1, c - (c - 1) ^ 2 / (n - 1) - 1))){end} AS v
FROM (SELECT sum(o * o / (ra * cb)) AS s, max(n) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS c FROM (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM t GROUP BY 1, 2)))"""


def _eta(cat: str, num: str, rounded: bool = True) -> str:
    start, end = ("round(", ", 6) + 0.0") if rounded else ("", "")
    return f"SELECT '{cat}' AS feature1, '{num}' AS feature2, {start}sqrt((SELECT sum(k * (m - (SELECT avg({num}) FROM t)) ^ 2) FROM (SELECT count(*) AS k, avg({num}) AS m FROM t GROUP BY {cat})) / (SELECT var_pop({num}) * count(*) FROM t)){end} AS eta"


def _splits() -> str:
    """The best split of each feature's top node."""
    g = oracles.impurity
    return f"""WITH {_LONG}, hist AS (SELECT feature, value, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS n, count(*) AS r FROM lng GROUP BY 1, 2),
run AS (SELECT *, sum(e) OVER w AS le, sum(n) OVER w AS ln_, sum(r) OVER w AS lr, sum(e) OVER f AS te, sum(n) OVER f AS tn, sum(r) OVER f AS tr FROM hist WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
c AS (SELECT feature, value, lr, round({g("te", "tn")} - (le + ln_) / (te + tn) * {g("le", "ln_")} - (te + tn - le - ln_) / (te + tn) * {g("te - le", "tn - ln_")}, 12) AS gain FROM run WHERE lr >= 5 AND tr - lr >= 5)
SELECT feature, round(value, 6) AS value, round(gain, 9) AS gain, CAST(lr AS BIGINT) AS rows_left FROM c WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, value) = 1"""


def _merge_sql(step: str) -> str:
    return f"""WITH {_BINS}, {step}
SELECT feature, bin, round(lower, 6) AS lower, events, non_events, round({_woe("events", "non_events")}, 6) + 0.0 AS woe, round({_iv("events", "non_events")}, 6) + 0.0 AS iv FROM o, tot"""


def _monotone(sign: str) -> str:
    """WoE from run to run by the sign; a feature without such runs is merged greedily."""
    both = ", o AS (SELECT * FROM best WHERE feature IN (SELECT feature FROM best_top) UNION ALL SELECT * FROM most WHERE feature NOT IN (SELECT feature FROM best_top))"
    return _merge_sql(oracles.optimal("bins", 5, "best", f"AND v.woe {sign} p.woe") + ",\n" + oracles.greedy("bins", 20, 5, "most") + both)


_HIST = "hist AS MATERIALIZED (SELECT feature, value, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS n, count(*) AS r FROM lng GROUP BY 1, 2)"
_LEAST = "(SELECT greatest(1, floor(count(*) * 5.0 / 100)) FROM lineitem)"
_CART = f"{_LONG}, {_HIST}, {oracles.tree('hist', 19, _LEAST, 'leaf')}, {oracles.tree_bins('hist', 'leaf', 'pre')}"


def _associations(numbers: list[str], texts: list[str]) -> str:
    """(f1, f2, c, measure, place) of all pairs, in the order that ties are taken in."""
    parts = [f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS c, 'Pearson' AS measure" + " FROM t" for a, b in _pairs(numbers)]
    parts += [f"SELECT feature1, feature2, v, 'CramersV' FROM ({_v(a, b, False)})" for a, b in _pairs(texts)]
    parts += [f"SELECT feature1, feature2, eta, 'Eta' FROM ({_eta(a, b, False)})" for a in texts for b in numbers]
    return " UNION ALL ".join(f"SELECT *, {k} AS place FROM ({p})" for k, p in enumerate(parts))


def _drops() -> str:
    numbers, texts = [*LINE, "revenue"], ["l_returnflag", "l_linestatus", "band"]
    return f"""WITH RECURSIVE {_PRICED.replace("t AS (SELECT *,", "t AS MATERIALIZED (SELECT *, (l_extendedprice > 50000)::INT AS y,", 1)},
tot AS (SELECT sum(y)::DOUBLE AS E, sum(1 - y)::DOUBLE AS N FROM t),
hist AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS n, count(*) AS r FROM t GROUP BY 2" for c in numbers)}),
{oracles.tree("hist", 19, _LEAST, "leaf")}, {oracles.tree_bins("hist", "leaf", "pre")}, {oracles.optimal("pre", 10, "o")}, {oracles.numeric_stats("hist", "o", "ns")},
cats AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS c, sum(y)::DOUBLE AS ev, sum(1 - y)::DOUBLE AS nev FROM t GROUP BY 2" for c in texts)}),
{oracles.category_groups("cats", 10, "cg")}, {oracles.category_stats("cg", "cs")},
stats AS MATERIALIZED (SELECT * FROM ns UNION ALL SELECT * FROM cs),
pairs AS MATERIALIZED ({_associations([*numbers, "y"], texts)}),
{oracles.drops("stats", "pairs", "y", 0.02, 0.9, "gone")}
"""


ORACLE_SQL = {
    "missing_ratio": _ratios(["doc_id", "lang", "source", "n_chars", "quality", "toxic"], "1.0"),
    "missing_ratio_weighted": _ratios(["doc_id", "lang", "source", "quality", "toxic"], "n_chars"),
    "missing_drop": f"SELECT * FROM ({_ratios(['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic'], '1.0')}) WHERE missing_ratio > 0.3 AND feature <> 'toxic'",
    "target_labels": "SELECT DISTINCT o_orderstatus AS label FROM orders WHERE o_orderstatus IS NOT NULL",
    "target_mask_counts": "SELECT count(*) FILTER (o_orderstatus = 'F') AS events, count(*) FILTER (o_orderstatus = 'O') AS non_events, count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS ignored FROM orders",
    "target_is_binary": "SELECT 'toxic' AS target, bool_and(toxic IN (0, 1)) AS already_binary FROM labels UNION ALL SELECT 'quality', bool_and(quality IN (0, 1)) FROM labels UNION ALL SELECT 'o_orderstatus', bool_and(o_orderstatus IN ('0', '1')) FROM orders",
    "weights_clean": "SELECT round(sum(CASE WHEN l_linenumber > 1 THEN l_quantity ELSE 1.0 END), 2) + 0.0 AS total_weight, count(*) AS n_rows FROM lineitem",
    "woe_by_category": f"WITH o AS (SELECT o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders WHERE o_orderstatus IN ('F', 'O')), tot AS (SELECT sum(y)::DOUBLE AS E, sum(1 - y)::DOUBLE AS N FROM o), g AS (SELECT category, sum(y)::DOUBLE AS ev, sum(1 - y)::DOUBLE AS nev FROM o GROUP BY 1) SELECT category, ev AS events, nev AS non_events, round({_woe('ev', 'nev')}, 6) + 0.0 AS woe, round({_iv('ev', 'nev')}, 6) + 0.0 AS iv, ev + nev AS count, round((ev + nev) * 100 / (tot.E + tot.N), 6) AS population_pct, round(ev / (ev + nev), 6) AS event_rate FROM g, tot",
    "woe_rare_other": f"WITH p AS (SELECT p_name, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END AS y, count(*) OVER (PARTITION BY p_name) AS k FROM part), tot AS (SELECT sum(y)::DOUBLE AS E, sum(1 - y)::DOUBLE AS N FROM p), g AS (SELECT CASE WHEN k < 30 THEN 'OTHER' ELSE p_name END AS category, count(*) AS rows, sum(y)::DOUBLE AS ev, sum(1 - y)::DOUBLE AS nev FROM p GROUP BY 1) SELECT category, rows, ev AS events, nev AS non_events, round({_woe('ev', 'nev')}, 6) + 0.0 AS woe, round({_iv('ev', 'nev')}, 6) + 0.0 AS iv FROM g, tot",
    "missing_bin_woe": f"WITH d AS (SELECT *, CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END AS y FROM {_LABELLED}), tot AS (SELECT sum(y)::DOUBLE AS E, sum(1 - y)::DOUBLE AS N FROM d), g AS (SELECT sum(y)::DOUBLE AS ev, sum(1 - y)::DOUBLE AS nev FROM d WHERE quality IS NULL) SELECT 'quality' AS feature, ev AS events, nev AS non_events, round({_woe('ev', 'nev')}, 6) + 0.0 AS woe, round({_iv('ev', 'nev')}, 6) + 0.0 AS iv FROM g, tot WHERE ev + nev > 0",
    "iv_categorical": f"WITH {_CATS} SELECT feature, round(sum(iv), 6) + 0.0 AS iv FROM w GROUP BY 1",
    "gini_categorical": f"WITH {_CATS}, g AS (SELECT feature, woe, sum(p) AS p, sum(q) AS q FROM w GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(p + q) OVER (PARTITION BY feature ORDER BY woe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT feature, round(2 * (sum(p * (before + (p + q) / 2)) - sum(p) * sum(p) / 2) / (sum(p) * sum(q)) - 1, 6) + 0.0 AS gini FROM r GROUP BY 1",
    "quantile_prebins": f"WITH {_BINS} SELECT feature, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, events, non_events FROM bins",
    "quantile_iv": f"WITH {_BINS} SELECT feature, round(sum({_iv('events', 'non_events')}), 6) + 0.0 AS iv FROM bins, tot GROUP BY feature",
    "quantile_gini": f"WITH {_GINI} SELECT feature, round(2 * auc - 1, 6) + 0.0 AS gini FROM a",
    "low_gini_features": f"WITH {_GINI} SELECT feature, round(2 * auc - 1, 6) + 0.0 AS gini FROM a WHERE abs(2 * auc - 1) < 0.5",
    "gini_impurity_by_quantity": f"WITH {_LINE}, h AS (SELECT l_quantity AS value, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS n FROM line GROUP BY 1) SELECT value, round(2 * (e / (e + n)) * (1 - e / (e + n)), 6) + 0.0 AS impurity FROM h",
    "best_split": _splits(),
    "cart_bins": f"WITH {_CART} SELECT feature, bin, round(lower, 6) AS lower, round(lead(lower) OVER (PARTITION BY feature ORDER BY bin), 6) AS upper, events, non_events FROM pre",
    "cart_iv": f"WITH {_CART}, {oracles.optimal('pre', 10, 'o')}, {oracles.numeric_stats('hist', 'o', 's')} SELECT feature, 'Numeric' AS feature_type, round(iv, 6) + 0.0 AS iv, round(gini, 6) + 0.0 AS gini FROM s",
    "categorical_cart_bins": f"WITH line AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS y FROM orders WHERE o_orderstatus IN ('F', 'O')), tot AS (SELECT sum(y)::DOUBLE AS E, sum(1 - y)::DOUBLE AS N FROM line), cats AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS c, sum(y)::DOUBLE AS ev, sum(1 - y)::DOUBLE AS nev FROM line GROUP BY 2), {oracles.category_groups('cats', 3, 'g')} SELECT feature, category, events, non_events, round({_woe('events', 'non_events')}, 6) + 0.0 AS woe, round({_iv('events', 'non_events')}, 6) + 0.0 AS iv FROM g, tot",
    "greedy_merge": _merge_sql(oracles.greedy("bins", 20, 5, "o")),
    "optimal_merge": _merge_sql(oracles.optimal("bins", 5, "o")),
    "optimal_merge_ascending": _monotone(">="),
    "associated": f"WITH {_PRICED} SELECT f1 AS feature1, f2 AS feature2, round(c, 6) + 0.0 AS correlation, measure FROM ({_associations([*LINE, 'revenue'], ['l_returnflag', 'l_linestatus', 'band'])}) WHERE abs(c) > 0.5",
    "drop_selection": _drops() + "SELECT feature, stage, reason FROM gone",
    "reduce_report": _drops() + "SELECT f AS feature, CASE WHEN stage IS NULL THEN 'kept' ELSE 'dropped' END AS status, stage AS dropped_at_stage FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'revenue', 'band']) AS f) LEFT JOIN gone ON gone.feature = f",
    "pearson_pairs": f"WITH {_PRICED} " + " UNION ALL ".join(_corr(a, b, None) for a, b in _pairs([*LINE, "revenue"])),
    "pearson_weighted": f"WITH {_PRICED} " + " UNION ALL ".join(_corr(a, b, "l_quantity") for a, b in _pairs(["l_extendedprice", "l_discount", "l_tax", "revenue"])),
    "cramers_v_pairs": f"WITH {_PRICED} " + " UNION ALL ".join(_v(a, b) for a, b in _pairs(["l_returnflag", "l_linestatus", "band"])),
    "eta_pairs": f"WITH {_PRICED} " + " UNION ALL ".join(_eta(a, b) for a in ("l_returnflag", "band") for b in ("l_quantity", "revenue")),
    "strata_counts": "SELECT coalesce(o_orderpriority, '(null)') AS value, count(*) AS population FROM orders GROUP BY 1",
    "sample_weights_stratified": "SELECT o_orderstatus AS value, round(count(*) / CASE o_orderstatus WHEN 'F' THEN 100.0 ELSE 50.0 END, 6) AS sampling_weight, CAST(CASE o_orderstatus WHEN 'F' THEN 100 ELSE 50 END AS BIGINT) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "sample_weights_equal": "SELECT c_mktsegment AS value, round(count(*) / 20.0, 6) AS sampling_weight, CAST(20 AS BIGINT) AS n FROM customer GROUP BY 1",
    "sample_random_size": "SELECT round(count(*) / round(count(*) * 0.1), 6) AS sampling_weight, CAST(round(count(*) * 0.1) AS BIGINT) AS n FROM orders",
    "schema_columns": "SELECT CAST(column_index - 1 AS INT) AS place, column_name AS name FROM duckdb_columns() WHERE table_name = 'nation'",
    "parquet_row_count": "SELECT count(*) AS n FROM lineitem",
    "convert_roundtrip": f"SELECT {', '.join(SOLD)} FROM lineitem",
    "convert_by_extension": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
    "csv_quoted": "SELECT p_partkey, 'a \"' || p_name || '\",' || chr(10) || p_brand AS label FROM part",
    "table_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}') AS n_columns, true AS has_size" for t in ("lineitem", "orders", "events")),
    "target_preview": "SELECT least(count(*), 1000) AS n, 'o_orderstatus' AS columns FROM orders",
    **dict.fromkeys(("sas_plain", "sas_rle", "sas_rdc", "sas_to_parquet"), "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CAST(DATE '2001-02-03' + CAST(c_custkey % 1000 AS INT) AS VARCHAR) AS day, CAST(TIMESTAMP '2001-02-03 04:05:06' + to_seconds(c_custkey) AS VARCHAR) AS at FROM customer"),
    "sas_columns": "SELECT * FROM (VALUES (0::INT, 'c_custkey', 'double'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'double'), (3, 'c_acctbal', 'double'), (4, 'day', 'date'), (5, 'at', 'timestamp_ntz')) AS t(place, name, type)",
    "optimal_merge_descending": _monotone("<="),
    "optimal_merge_auto": _merge_sql(oracles.optimal("bins", 5, "o")),
    "merge_of_few_bins": f"WITH {_BINS} SELECT feature, bin, round(lower, 6) AS lower, events, non_events FROM bins",
    "correlation_matrix": f"WITH {_PRICED} " + " UNION ALL ".join(_corr(a, b, None) for a in [*LINE, "revenue"] for b in [*LINE, "revenue"]),
    "matrix_pairs": f"WITH {_PRICED} SELECT * FROM (" + " UNION ALL ".join(_corr(a, b, None) for a, b in _pairs([*LINE, "revenue"])) + ") WHERE abs(r) > 0.1",
    "column_kinds": "SELECT CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'other' END AS kind, column_name AS name FROM duckdb_columns() WHERE table_name = 'lineitem'",
    "drop_columns": "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, 'l_quantity,l_discount,l_returnflag,l_linestatus' AS columns FROM lineitem GROUP BY 1",
    "binary_targets": "SELECT * FROM (VALUES ('toxic', 'ok'), ('o_orderstatus', 'must be binary (0/1), or a mapping of its labels is needed'), ('l_linenumber', 'must be binary (0/1), or a mapping of its labels is needed'), ('n_regionkey', 'has one class only')) AS t(target, told)",
    "gini_report_features": f"WITH {_CART}, {oracles.optimal('pre', 10, 'o')}, {oracles.numeric_stats('hist', 'o', 's')} SELECT feature, 'Numeric' AS feature_type, n_bins, events, round(iv, 6) + 0.0 AS iv, round(gini, 6) + 0.0 AS gini FROM s JOIN (SELECT feature, count(*) AS n_bins, sum(events) AS events FROM o GROUP BY 1) USING (feature)",
    "csv_report_rows": _drops() + "SELECT stats.feature, CASE WHEN stage IS NULL THEN 'kept' ELSE 'dropped' END AS status, coalesce(stage, '') AS dropped_at_stage, coalesce(reason, '') AS reason, '0.0000' AS missing_ratio, printf('%.4f', gini) AS gini, printf('%.4f', iv) AS iv, CASE WHEN stats.feature IN ('l_returnflag', 'l_linestatus', 'band') THEN 'Categorical' ELSE 'Numeric' END AS feature_type FROM stats LEFT JOIN gone USING (feature)",
    "summary_lines": _drops() + "SELECT 9::INT AS before, CAST(9 - count(*) AS INT) AS after, 0::INT AS by_missing, CAST(count(*) FILTER (stage = 'gini') AS INT) AS by_gini, CAST(count(*) FILTER (stage = 'correlation') AS INT) AS by_correlation FROM gone",
    "waterfall": "SELECT * FROM (VALUES ('a', 'Correlated with target (Pearson 0.9900); dropped to protect target'), ('c', 'Correlated with b (Eta 0.9800); lower IV (0.2000 vs 0.3000)'), ('d', 'Correlated with e (Pearson 0.9700); higher frequency (2 vs 1)'), ('h', 'Correlated with g (CramersV 0.9500); higher missing ratio (0.2000 vs 0.1000)'), ('k', 'Correlated with j (Pearson 0.9400); alphabetical tie-break')) AS t(feature, reason)",
    "sample_parsed_sizes": "SELECT o_orderstatus AS value, round(count(*) / CASE o_orderstatus WHEN 'F' THEN 30.0 ELSE 20.0 END, 6) AS sampling_weight, CAST(CASE o_orderstatus WHEN 'F' THEN 30 ELSE 20 END AS BIGINT) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
}
