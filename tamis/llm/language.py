"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed byte n-grams
(2 and 3 bytes) is trained: log-odds weights of the grams, averaged over a text, and a
logistic scale. A text gets the language whose codeword has the least total loss, where a
bit's loss is weighted by how well its classifier does in training. The score is the
normalised likelihood of the choice; a text is ambiguous if the next codeword's loss is
within ``GAP``.

Training takes at most ``SAMPLE`` texts (at least ``LEAST`` a language), chosen by a hash
of doc_id; prediction reads every whole text. With one language there are no bits and it
is always chosen; with none all is ``und``.

A text that is null or has no letter (Unicode's category L) is ``und`` with score 0. Rows with
null lang, text or doc_id aren't learned from, nor is a fifth of the ids, which is held out.
Of codewords of equal loss the first language's, in order of names, is taken. Repeated rows
are judged one by one, and count as often in training. An empty table gives an empty result.
A very long text is read whole, once; its counts take as much room as a short one's. Added
columns get underscores in front if docs has their names.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, named, prepare, schema_of, table, unused

SAMPLE, LEAST = 3_000, 50
PARTS = 256
BITS = 12
GAP = 0.7
LETTER = regex.compile(r"\p{L}")


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams of a text, A-Z lower-cased."""
    b = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    return np.bincount(np.concatenate((two, three)) >> np.uint32(32 - BITS), minlength=1 << BITS)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits for up to 7 languages, else well separated random ones."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 7:
        return np.array([(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest], float).T
    rng = np.random.default_rng(7)
    bits = 10 * math.ceil(math.log2(n))
    tries = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(200)]
    tries = [t for t in tries if (np.abs(t.sum(axis=0)) < n).all()] or tries
    return min(tries, key=lambda t: (t @ t.T - 2 * bits * np.eye(n)).max())


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def losses(self, mean: np.ndarray) -> np.ndarray:
        """(texts, languages) from mean log-odds (texts, bits)."""
        margin = mean * self.scale + self.shift
        plus, minus = np.logaddexp(0, -margin) * self.trust, np.logaddexp(0, margin) * self.trust
        on = (self.codes > 0).astype(float)
        return plus @ on.T + minus @ (1 - on).T

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        counts = gram_counts(text)
        loss = self.losses((counts @ self.weights / max(1, counts.sum()))[None])[0]
        best = int(loss.argmin())
        chance = np.exp(loss[best] - loss)
        others = np.delete(loss, best)
        return self.langs[best], float(1 / chance.sum()), bool(len(others) and others.min() - loss[best] < GAP)


def fitted(langs: list[str], labels: list[str], counts: np.ndarray) -> Model:
    """From the gram counts (texts, grams) of labelled texts."""
    codes = codewords(len(langs))
    index = np.array([langs.index(x) for x in labels], np.int64)
    per = np.zeros((len(langs), counts.shape[1]))
    for k in range(len(langs)):
        own = counts[index == k]
        # a text counts by the root of its length, languages alike
        per[k] = (own / np.sqrt(np.maximum(1, own.sum(axis=1, keepdims=True)))).sum(axis=0)
        per[k] /= max(1e-9, per[k].sum())
    bits = codes.shape[1]
    weights, scale, shift, trust = np.zeros((counts.shape[1], bits)), np.ones(bits), np.zeros(bits), np.ones(bits)
    size = np.maximum(1, counts.sum(axis=1))
    for b in range(bits):
        on = codes[:, b] > 0
        weights[:, b] = np.log(per[on].mean(axis=0) + 1e-6) - np.log(per[~on].mean(axis=0) + 1e-6)
        x, y = counts @ weights[:, b].astype(np.float32) / size, on[index].astype(float)
        scale[b], shift[b] = logistic(x, y)
        right = ((x * scale[b] + shift[b] > 0) == (y > 0)).mean()
        trust[b] = 0.5 * math.log((right + 1e-2) / (1 - right + 1e-2))
    trust = np.maximum(trust, 0) / max(1e-9, trust.clip(0).max(initial=0)) if bits else trust
    return Model(langs, codes, weights, scale, shift, trust)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic regression with a small ridge, by Newton steps."""
    a, c = np.stack((x, np.ones(len(x))), axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-4, 1e-2])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-4, 1e-2]) * c)
        c = c + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return float(c[0]), float(c[1])


def held_out(doc_id="doc_id"):
    """True for a fifth of the ids: crc32 of the id's text divides by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def trained(docs: DataFrame) -> Model:
    """A model of the documents that aren't held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    langs = sorted(r.lang for r in usable.select("lang").distinct().toLocalIterator())
    if not langs:
        return Model([], np.zeros((0, 0)), *(np.zeros(0) for _ in range(4)))
    each = max(LEAST, SAMPLE // len(langs))
    # the least hashes of each of PARTS parts of a language first, so no language is sorted in one task
    inside, order = Window.partitionBy("lang", "part").orderBy("h", "doc_id"), Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(PARTS)))
    least = ids.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= each)
    chosen = least.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("lang", "doc_id")

    def make():
        def each_(b):
            rows = []
            for t in b.column(1).to_pylist():
                c = gram_counts(t)
                at = np.flatnonzero(c)
                rows.append(np.stack((at, np.minimum(c[at], 0xFFFF))).astype("<u2").tobytes())
            yield batch(["lang", "counts"], b.column(0), pa.array(rows, pa.binary()))

        return each_

    texts = docs.select("lang", "doc_id", "text").join(F.broadcast(chosen.distinct()), ["lang", "doc_id"]).where("text is not null")
    got = map_arrow(texts.select("lang", "text"), make, "lang string, counts binary").limit(2 * max(SAMPLE, each * len(langs))).toArrow()
    counts = np.zeros((got.num_rows, 1 << BITS), np.float32)
    for k, packed in enumerate(got["counts"]):
        at, n = np.frombuffer(packed.as_buffer(), "<u2").reshape(2, -1)
        counts[k, at] = n
    return fitted(langs, got["lang"].to_pylist(), counts)


def added(docs: DataFrame) -> list[str]:
    """What predictions() calls its columns: lang_pred, score and ambiguous, unless docs has these."""
    return [unused(docs, c) for c in ("lang_pred", "score", "ambiguous")]


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and those that added() names."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    names, (lang_pred, score_name, ambiguous) = docs.columns, added(docs)

    def make():
        m, k = shared.value, names.index("text")

        def each(b):
            lang, score, unsure = zip(*(m.predict(t) for t in b.column(k).to_pylist()), strict=True)
            yield batch([*names, lang_pred, score_name, ambiguous], *b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_()))

        return each

    return map_arrow(docs, make, f"{schema_of(docs)}, {lang_pred} string, {score_name} double, {ambiguous} boolean")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents in which a language was found: null texts and those without letters go.

    lang becomes the language predicted; where that is ambiguous, a lang that was given stays.
    Columns as in docs.
    """
    prepare(docs.sparkSession)
    lang_pred, _, ambiguous = added(docs)
    told = F.when(F.col(ambiguous) & F.col("lang").isNotNull(), F.col("lang")).otherwise(F.col(lang_pred))
    found = predictions(docs, trained(docs)).where(F.col(lang_pred) != "und")
    return found.select(*[told.alias("lang") if c == "lang" else named(c) for c in docs.columns])


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    prepare(spark)
    model = trained(docs)
    out = predictions(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
