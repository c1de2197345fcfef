"""Secret scan: candidates by patterns, false positives removed by a random forest. DataFrame functions only.

A candidate is described by its length, its character transitions (the share of neighbours of
different classes, and how likely its letters follow each other in the corpus' own words), the
shares of distinct characters, digits and hexadecimal ones, how much of it dictionary words
cover, whether it is part of a path, what assigns it, and its neighbouring words: how many
there are, and how many of them tell of examples or of use.

Letter transitions are counted over all words of all documents; the dictionary are the
``DICTIONARY`` most frequent words of four letters or more (the model's size, not a sample) and
some fixed placeholders. The forest is trained on labelled findings that a seeded generator makes
from the rules below and from dictionary words, as no table labels secrets, and is compiled to SQL
expressions: scanning runs in the JVM alone.

Every candidate is returned: doc_id, at (from 1, in order), rule, candidate_sha256 (not
the secret), n_chars, score and is_secret. Null and empty texts have none; a text may hold
any number, and be of any length. Of rules that begin at one place the first holds. Repeated
documents are scanned one by one; an empty table gives an empty result. doc_id and text are read
alone, so other columns' names can't clash.
"""

from __future__ import annotations

import base64
import functools
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, prepare, stored, table

# Rules, in order; the pattern's match is the candidate with what assigns it.
# A key block reaches to its END line, or over the base64 lines that follow if it has none.
RULES = {
    "private_key": r"-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:(?:(?!-----)(?s:.))*+-----END [A-Z ]*?PRIVATE KEY-----|(?:\s++[0-9A-Za-z+/]{32,}+={0,2})*+)",
    "aws_key": r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack": r"\bxox[abprs]-[0-9A-Za-z-]{10,}+",
    "google": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}
ISSUED = "|".join(RULES.values())
# What is assigned to a telling name: the name from its first character (or from the last match), any blanks, the whole value.
# A key of the other rules is no part of the name, and a key block no value.
RULES["assigned"] = rf"(?i:(?:(?<![a-z0-9_.-])|\G)(?:(?!(?-i:{ISSUED}))[a-z0-9_.-])*?(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?[\"']?\s*+(?::=|=>|[:=])\s*+[\"'`]?(?!-----BEGIN )[0-9A-Za-z+/_.$@!%-]{{8,}}+={{0,2}})"
PATTERN = "|".join(RULES.values())
# Text that any match holds, as it stands and in lower case; the rest isn't looked at closer.
CORES = ["-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "eyJ"]
LOW_CORES = ["token", "secret", "passw", "pwd", "key", "credential"]
# Placeholders, and words that tell of harmless or of real values nearby.
PLACEHOLDERS = "example sample changeme placeholder password secret token dummy test your here insert none null undefined true false value string config default admin user name foo bar baz lorem ipsum key api xxxx 0000 1234 abcd".split()
HARMLESS = "example sample dummy fake mock placeholder test fixture checksum digest commit revision sha1 sha256 md5 uuid etag".split()
REAL = "production prod live aws deploy login connect export env secret credential private".split()
DICTIONARY = 2_000
TREES, DEPTH, FINDINGS, SEED = 15, 5, 1_500, 7
FEATURES = ["length", "changes", "follows", "distinct", "digits", "hex", "covered", "path", "keyed", "quoted", "words", "harmless", "real", "repeats", "issued"]
CONTEXT = 60
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Corpus:
    """What the model knows of the corpus: its frequent words, and the log chances of a letter after another (26 x 26)."""

    words: tuple[str, ...]
    follows: tuple[float, ...]


def corpus_of(docs: DataFrame) -> Corpus:
    """Counts all words that are written like words (a-z, perhaps with a capital), and their letter pairs."""
    words = docs.select(F.explode(F.split("text", "[^0-9A-Za-z_]+")).alias("word")).where(F.col("word").rlike("^[A-Za-z][a-z]+$")).select(F.lower("word").alias("word"))
    counts = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    top = counts.where(F.length("word").between(4, 12)).orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    # a word of more than 64 letters is no word
    pairs = counts.where(F.length("word") <= 64).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substr("word", k, F.lit(2)))).alias("pair"))
    found = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # at most 26 x 26
    dropped(docs.sparkSession, counts)
    follows = []
    for a in LETTERS:
        row = [found.get(a + b, 0) + 1 for b in LETTERS]
        follows += [round(math.log(x / sum(row)), 6) for x in row]
    return Corpus(tuple(r.word for r in top), tuple(follows))


def any_of(words) -> str:
    """A pattern of any of the words, longest first, grouped by their first letters."""
    groups: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(groups.items()))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, at, whole, before, behind): every match, with up to CONTEXT characters on its sides."""
    text, low = F.col("text"), F.lower("text")
    may = [text.contains(c) for c in CORES] + [low.contains(c) for c in LOW_CORES]
    hit = docs.select("doc_id", "text").where(functools.reduce(lambda a, b: a | b, may))
    both = hit.select("doc_id", F.regexp_extract_all("text", F.lit(f"({PATTERN})"), F.lit(1)).alias("found"), F.split("text", PATTERN, -1).alias("parts"))
    rows = both.select("doc_id", F.posexplode(F.arrays_zip("found", F.slice("parts", 1, F.size("found")).alias("left"), F.slice("parts", 2, F.size("found")).alias("right"))).alias("k", "m"))
    return rows.select("doc_id", (F.col("k") + 1).cast("int").alias("at"), F.col("m.found").alias("whole"), F.substring_index(F.right(F.col("m.left"), F.lit(CONTEXT)), "\n", -1).alias("before"), F.substring_index(F.left(F.col("m.right"), F.lit(CONTEXT)), "\n", 1).alias("behind"))


def described(found: DataFrame, corpus: Corpus) -> DataFrame:
    """Adds rule, value and FEATURES to whole, before and behind."""
    whole = F.col("whole")
    rule = F.coalesce(*[F.when(whole.rlike(f"^(?:{p})$"), name) for name, p in RULES.items()], F.lit("assigned"))
    bare = F.regexp_extract(whole, r"""(?s)^[^:=]*?["']?\s*(?::=|=>|[:=])\s*["'`]?(.*)$""", 1)
    df = found.withColumn("rule", rule).withColumn("value", F.when(F.col("rule") == "assigned", bare).otherwise(whole))
    v = F.col("value")
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    low = F.lower(v)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^0-9A-Za-z]", "-"), "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "x"))
    known = any_of([*corpus.words, *PLACEHOLDERS])
    near = F.lower(F.concat_ws(" ", "before", "behind"))
    # words, but not the parts of addresses, paths and other names
    told = lambda of: F.size(F.regexp_extract_all(near, F.lit(rf"(?<![\w.@/-])((?:{'|'.join(of)}))(?![\w@/-]|\.\w)"), F.lit(1)))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(v) - 1, F.lit(1))), lambda k: F.substr(low, k, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    table = F.array(*map(F.lit, corpus.follows))
    chance = F.transform(pairs, lambda p: F.get(table, (F.ascii(p) - 97) * 26 + F.ascii(F.substr(p, F.lit(2))) - 97))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    feature = {
        "length": size,
        "changes": (runs - 1) / size,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / size,
        "digits": F.length(F.regexp_replace(v, "[^0-9]", "")) / size,
        "hex": F.length(F.regexp_replace(low, "[^0-9a-f]", "")) / size,
        "follows": F.when(F.size(pairs) > 0, F.aggregate(chance, F.lit(0.0), lambda a, x: a + x) / F.size(pairs)).otherwise(-9.0),
        "covered": 1 - F.length(F.regexp_replace(low, known, "")) / size,
        "path": flag(v.rlike(r"^[./~]|/[A-Za-z._-]{3,}/|\.[a-z]{2,4}$") | F.col("before").rlike(r"[/\\]$")),
        "keyed": flag(whole.rlike(r"(?i)(token|secret|key|passw|credential)")),
        "quoted": flag(whole.rlike("[\"'`]")),
        "words": F.size(F.regexp_extract_all(near, F.lit(r"([^\W\d_]{2,})"), F.lit(1))),
        "harmless": told(HARMLESS),
        "real": told(REAL),
        "issued": flag(F.col("rule") != "assigned"),
        "repeats": 1 - F.length(F.regexp_replace(low, r"(.)\1+", "$1")) / size,
    }
    return df.withColumns({k: F.coalesce(x.cast("double"), F.lit(0.0)) for k, x in feature.items()})


def labelled_findings(n: int = FINDINGS, seed: int = SEED, words: tuple[str, ...] = ()) -> list[tuple[str, str, str, float]]:
    """(whole, before, behind, label): findings as a reviewer would label them, made by rule from a seed, of ``words`` and invented ones."""
    rng = random.Random(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(words) if words and rng.random() < 0.7 else some(lower, rng.randint(2, 9))
    mail = lambda: f" {word()}@{word()}.example.com"
    prose = lambda k: " ".join(word() for _ in range(rng.randint(0, k)))

    def real() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return "AKIA" + some(upper + digits, 16)
        if kind == 8:
            return "-----BEGIN " + rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----"
        if kind == 1:
            return "ghp_" + some(upper + lower + digits, 36)
        if kind == 2:
            return "xoxb-" + some(digits, 11) + "-" + some(upper + lower + digits, 24)
        if kind == 3:
            return "AIza" + some(upper + lower + digits + "_-", 35)
        if kind == 4:
            return "eyJ" + some(upper + lower + digits, 17) + "." + some(upper + lower + digits, 40) + "." + some(upper + lower + digits + "_-", 43)
        value = rng.choice([lambda: some(digits + "abcdef", rng.randint(16, 64)), lambda: some(digits + "ABCDEF", rng.randint(16, 64)), lambda: base64.b64encode(rng.randbytes(rng.choice([24, 30, 33]))).decode(), lambda: some(upper + lower + digits + "!@$%", rng.randint(12, 20))])()
        q = rng.choice(['"', '"', "'", ""])
        return rng.choice(["token", "secret", "api_key", "password", "access_key", "auth_key"]) + rng.choice([" = ", "=", ": "]) + q + value

    def harmless() -> str:
        name = rng.choice(["token", "secret", "api_key", "password", "pwd"]) + rng.choice([" = ", "=", ": "]) + rng.choice(['"', "'", ""])
        kind = rng.randrange(8)
        if kind == 0:
            return name + rng.choice(["changeme", "your_password_here", "YOUR-API-KEY", "example_token", "insert_secret_here", "placeholder", "undefined", "none_value"]) + rng.choice(["", some(digits, 2)])
        if kind == 1:
            return name + rng.choice("x*0X.") * rng.randint(8, 40) if rng.random() < 0.5 else name + rng.choice(["xxxx", "1234", "0000", "abcd"]) * rng.randint(2, 10)
        if kind == 2:
            return name + "/".join(["", *(word() for _ in range(rng.randint(2, 4)))]) + rng.choice(["", ".txt", ".json", ".pem"])
        if kind == 3:
            return name + "_".join(word() for _ in range(rng.randint(2, 4)))
        if kind == 4:
            return name + some(lower, rng.randint(8, 14))
        if kind == 5:
            return "AKIA" + rng.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "0000000000000000"])
        if kind == 6:
            return name + word() + "." + word() + "." + word()
        return name + "".join(w.capitalize() for w in (word(), word(), word()))

    out = []
    for _ in range(n // 2):
        out.append((real(), prose(6) + rng.choice(["", " ", mail() + " ", " " + rng.choice(REAL) + " "]), rng.choice(['"', "", " "]) + prose(5), 1.0))
        # what is random but told to be a checksum or an example is harmless, too
        whole = harmless() if rng.random() < 0.75 else "token = " + some(digits + "abcdef", rng.choice([32, 40]))
        told = "" if rng.random() < 0.3 and not whole.startswith("token = ") else rng.choice(HARMLESS)
        out.append((whole, f"{prose(4)} {told} ", rng.choice(['"', "", " "]) + prose(4), 0.0))
    return out


def tree_sql(node) -> str:
    """A tree of the trained forest as a SQL expression of the chance of a secret."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / max(1e-9, sum(stats)):.6f}D"
    split = node.split()
    return f"CASE WHEN {FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {tree_sql(node.leftChild())} ELSE {tree_sql(node.rightChild())} END"


def forest(spark: SparkSession, corpus: Corpus) -> Column:
    """The score of a forest that is trained for the corpus, as an expression of FEATURES."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = described(spark.createDataFrame(labelled_findings(words=corpus.words), "whole string, before string, behind string, label double"), corpus).select(*FEATURES, "label")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(data)
    trees = [tree_sql(t._call_java("rootNode")) for t in model.trees]
    return sum((F.expr(t) for t in trees), F.lit(0.0)) / len(trees)


def scanned(docs: DataFrame, least: float = 0.5) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    corpus = corpus_of(docs)
    df = described(candidates(docs), corpus).withColumn("score", F.round(forest(spark, corpus), 6))
    return df.select("doc_id", "at", "rule", F.sha2(F.col("value").cast("binary"), 256).alias("candidate_sha256"), F.length("value").alias("n_chars"), "score", (F.col("score") >= least).alias("is_secret"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents", "doc_id", "text"))
