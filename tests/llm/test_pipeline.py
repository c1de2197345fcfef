"""run() against its stages in plain Python, on planted cases."""

import hashlib
import random
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tamis.llm import bpe, decontam, language, near_dedup, pii, token_files

from test_ops import brute_classes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, path, rows, items):
    full = [(i, t, x, "s", len(t or "")) for i, t, x in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_run(spark, tmp_path):
    spark.conf.set(pii.KEY_SETTING, "the key")
    text = lambda k, n=60: " ".join(f"word{(k * 7919 + j * 104729) % 9973}x" for j in range(n))
    item = " ".join(f"bench{j}" for j in range(20))
    rows = [(1, text(1)), (2, text(1)), (3, text(1) + " more"), (4, text(2) + " " + item + " " + text(3)), (5, item), (6, "12345 !!"), (7, None), (8, text(4) + " mail me.now@host.example.com"), (9, text(5))]
    stored(spark, tmp_path, [(i, t, "en") for i, t in rows], [item])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    spark.conf.unset(pii.KEY_SETTING)
    assert sorted(got) == [1, 4, 8, 9]
    codec, cut = bpe.codec_of(bpe.default_path()), decontam.cut(rows[3][1].encode(), [(60, 80)]).decode()
    for i, want in ((1, text(1)), (4, cut), (8, pii.replaced(rows[7][1], b"the key")[0]), (9, text(5))):
        ids = codec.encode(want)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(np.frombuffer(ids, "<u4")), hashlib.sha256(ids).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(want.encode()).hexdigest()


def brute(rows, items, lang_of, key):
    """All stages in plain Python: doc_id -> text."""
    left = [(i, t) for i, t in rows if lang_of[i, t] != "und"]
    named = {}
    for (i, t), (_, c) in zip(sorted(left, key=str), brute_classes(left)):
        named.setdefault(c, []).append((i, t))
    left = [min(x) for x in named.values()]
    windows = {tuple(w[k : k + 10]) for w in (decontam.words(t.encode()) for t in items if t) if w for k in range(max(1, len(w) - 9))}
    out = {}
    for i, t in left:
        spots = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", t.encode())]
        ws, hit = decontam.words(t.encode()), set()
        for n in {len(x) for x in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) > 0.5 * len(ws):
            continue
        raw, runs = t.encode(), []
        for k in sorted(hit):
            if runs and runs[-1][1] == k:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
        for a, e in reversed(runs):
            raw = raw[: spots[a][0]] + raw[spots[e - 1][1] :]
        out[i] = pii.replaced(raw.decode(), key)[0]
    return out


def test_run_on_a_random_corpus(spark, tmp_path):
    spark.conf.set(pii.KEY_SETTING, "the key")
    rng = random.Random(14)
    vocab = {"en": ["the", "house", "with", "and", "thing", "water", "other"], "de": ["und", "der", "nicht", "schön", "haus", "wasser", "auch"]}
    prose = lambda x, n: " ".join(rng.choice(vocab[x]) + str(rng.randint(0, 400)) for _ in range(n))
    items = [prose("en", 25), prose("de", 12), "", None, "alone4 again5"]
    rows = []
    for k in range(120):
        x = "en" if k % 2 else "de"
        t = prose(x, rng.choice([3, 8, 40, 90]))
        if rows and k % 6 == 0:
            t = rng.choice(rows)[1] + rng.choice(["", " end"])
        if k % 7 == 0:
            t += " " + items[k % 2] + " " + prose(x, 30)
        if k % 9 == 0:
            t += " mail a.b@c.example.org"
        rows.append((k, t))
    rows += [(200, "123 45"), (201, ""), (202, "½ ²")]
    wrong = {k: "de" for k in range(1, 12, 4)}  # English, labelled German
    stored(spark, tmp_path, [*((i, t, wrong.get(i, "en" if i % 2 else "de")) for i, t in rows), (203, None, "en")], items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corrected = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert sum(corrected[k] == "en" for k in wrong) >= len(wrong) - 1 and not {200, 201, 202, 203} & set(corrected)
    lang_of = {(i, t): "x" if any(c.isalpha() for c in t) else "und" for i, t in rows}
    want = brute(rows, items, lang_of, b"the key")
    run = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in run.collect()}
    spark.conf.unset(pii.KEY_SETTING)
    lib = Tokenizer.from_file(bpe.default_path())
    assert sorted(got) == sorted(want) and len(got) > 60
    for i, t in want.items():
        assert got[i].ids == lib.encode(t, add_special_tokens=False).ids and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_run_on_an_empty_table(spark, tmp_path):
    stored(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
    rows = [(1, "the one text", "en", "s", 12), (None, "another text of mine", None, None, None), (2, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for stage in (language.known_language, near_dedup.one_of_each, lambda d: pii.with_surrogates(d, b"k"), lambda d: decontam.decontaminate(d, spark.createDataFrame([], "item_id long, text string"))):
        assert stage(docs).columns == docs.columns and stage(docs).where("doc_id = 1").count() == 1
    assert token_files.END_ID == 2
