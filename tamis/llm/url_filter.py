"""URL filters by a sort-merge range join, with DataFrame functions only.

A host's canonical key is its labels in reverse, each closed by a dot, so a rule's host
and all subdomains are one interval of keys, and intervals are nested or apart. The
boundaries of all intervals and the urls' keys are sorted together; a sweep carries the
stack of active rules from each boundary to the urls behind it. Among the stack's rules
whose path the url's path starts with, the longest wins (host and path together; the
longer host on ties).

Urls are dealt out evenly, row by row, and every part sweeps all boundaries, so neither a host
nor a row that repeats makes a large part. A sweep takes at most ``MAX_RULES`` rules; more rules
take more sweeps, of which the best rule of all stands.

A url that is null or has no ``://`` has an empty host and path; no rule fits it and it is
allowed. Repeated rows are judged one by one. Of rules with equal host and path the first
stands. An empty table gives an empty result; a url may be of any length. judged() reads the two
named columns, filtered() carries all columns in one struct, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, prepare, table

MAX_RULES = 100_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<host:string,path:string,action:string>>"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: list[tuple[str, str, str]]) -> list[tuple[str, list]]:
    """(key, stack of rules active from there on), in order of the keys; rules of one host are one level."""
    levels: dict[str, dict] = {}
    for action, host, path in rules:
        host = host.translate(str.maketrans(UPPER, LOWER))
        key = ".".join(reversed(host.split("."))) + "."
        levels.setdefault(key, {}).setdefault((host, path), {"host": host, "path": path, "action": action})
    out: dict[str, list] = {}
    open_: list[str] = []

    def told(key: str) -> None:
        out[key] = [r for k in open_ for r in levels[k].values()]

    def close(until: str) -> None:
        while open_ and not until.startswith(open_[-1]):
            end = open_.pop()[:-1] + "/"  # the first key behind all that start with "end."
            told(end)

    for key in sorted(levels, key=str.encode):
        close(key)
        open_.append(key)
        told(key)
    close("\0")
    return sorted(out.items(), key=lambda x: x[0].encode())


def swept(urls: DataFrame, rules: list[tuple[str, str, str]], n: int) -> DataFrame:
    """urls (part, key, page_id, host, path, best) with the better of best and the best of these rules."""
    spark = urls.sparkSession
    marks = spark.createDataFrame([(k, s) for k, s in boundaries(rules)], f"key string, stack {STACK}")
    of_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in urls.schema if f.name not in ("part", "key")]
    marks = marks.select(of_part, "key", *empty, F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = urls.withColumns({"kind": F.lit(1), "stack": F.lit(None).cast(STACK)}).unionByName(marks)
    active = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fit = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    # the greatest of (length, host's length) is the longest; the host's key interval has seen to the host
    ranked = F.transform(fit, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("own"), F.concat(r["host"], r["path"]).alias("rule"), r["action"].alias("action")))
    best = F.array_max(ranked)
    # of equal ones the sweep before stands
    better = F.col("best").isNull() | (F.struct(best["size"], best["own"]) > F.struct(F.col("best.size").alias("size"), F.col("best.own").alias("own")))
    return active.withColumn("best", F.when(best.isNotNull() & better, best).otherwise(F.col("best"))).select(urls.columns)


BEST = "struct<size:int,own:int,rule:string,action:string>"


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", *, url_col: str = "url", id_col: str = "page_id", most: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark = pages.sparkSession
    prepare(spark)
    n = partitions(spark)
    url = F.col(url_col)
    urls = pages.select(F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("part"), F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.select("part", host_key(F.col("host")).alias("key"), "page_id", "host", "path", F.lit(None).cast(BEST).alias("best"))
    for k in range(0, len(rules), most):
        urls = swept(urls, rules[k : k + most], n)
    return urls.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """The rows whose url is allowed, with all columns."""
    keyed = pages.withColumn("_page", F.struct(*[F.col(f"`{c}`") for c in pages.columns])).withColumn("_url", F.col("url")).select("_page", "_url")
    out = judged(keyed, rules, default, url_col="_url", id_col="_page")
    return out.where("verdict = 'allow'").select("page_id.*")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages", "page_id", "url"), RULES)


OP1_SQL = """
WITH u AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u),
r AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
         END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
