import random

import numpy as np
import pytest

from panelflow.llm import langid, queries
from panelflow.llm.common import crc_mod

SYLLABLES = {"xx": ["ka", "ro", "mi", "tu", "sel"], "yy": ["sch", "ung", "bei", "er", "zu"], "zz": ["ção", "lho", "es", "ão", "que"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 150))]
        rows.append((i, " ".join(words), lang, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def model(corpus):
    return langid.fit(corpus.where(crc_mod("doc_id", 4) != 2))


def test_marginals_agree_with_enumeration():
    """Blocks carried over long texts give what one pass over the whole text gives."""
    rng = np.random.default_rng(2)
    moves = langid.unit(rng.random((3, 3)) + 0.1)
    sizes = np.array([1, 5, 64, 65, 300, 2])
    e = rng.random((sizes.sum(), 3)) + 0.01
    got, at = langid.marginals(e, moves, sizes), 0
    for n in sizes:
        part = e[at : at + n]
        forward, a = [], np.full(3, 1 / 3)
        for row in part:
            a = langid.unit((a @ moves) * row)
            forward.append(a)
        b, want = np.full(3, 1 / 3), [None] * n
        for t in range(n - 1, -1, -1):
            want[t] = langid.unit(forward[t] * b)
            b = langid.unit(moves @ (part[t] * b))
        assert np.allclose(got[at : at + n], want)
        at += n


def test_held_out_accuracy(corpus, model):
    held = langid.predict(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").where(crc_mod("doc_id", 4) == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert model.langs == ["xx", "yy", "zz"] and (np.diag(model.moves) > 0.5).all()


def test_words_of_switched_text(model):
    words, p, _ = langid.Tagger(model).tag(["karomi tusel rokami schung beizu ungsch zuer"])
    assert [model.langs[k] for k in p.argmax(1)] == ["xx"] * 3 + ["yy"] * 4


def test_odd_rows(odd_docs, no_docs, model, spark):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd_docs, model).collect() if r["doc_id"] in (2, 3, 4)}
    assert got == {(i, "und", 0.0) for i in (2, 3, 4)}
    assert langid.predict(odd_docs, model).count() == odd_docs.count()
    assert langid.predict(no_docs, model).collect() == []
    none = langid.fit(odd_docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(odd_docs, none).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (2, 3, 4)").count() == 0


def test_switched_texts_are_identified(spark, odd_docs, model):
    """A text of three languages in equal parts has a share near a third; it stays, as all that predict() names."""
    text = "karomituselromika karomituselromi schungbeierzus schungbeierzus çãolhoesãoques çãolhoesãoques"
    df = spark.createDataFrame([(1, text), (2, "12 34"), (3, None)], "doc_id long, text string")
    row = langid.predict(df, model).where("doc_id = 1").first()
    assert row["lang_pred"] != "und" and row["score"] < 0.45
    assert [r["doc_id"] for r in langid.keep_identified(df, model).collect()] == [1]
    even = langid.Model(langs=["a", "b", "c", "d"], weights=np.zeros((1 << langid.BITS, 4), np.float32), moves=np.full((4, 4), 0.25))
    assert langid.predict(df, even).where("doc_id = 1").first()["score"] < 0.35
    assert [r["doc_id"] for r in langid.keep_identified(df, even).collect()] == [1]
    none = langid.fit(odd_docs.where("lang is null"))
    assert langid.keep_identified(df, none).collect() == []


def test_letters_are_of_category_l(spark, model):
    """Signs that count as word characters but are no letters don't make a word."""
    texts = ["\u00b2", "\u00bd \u2460 \u2167", "12\u00b3_", "\u0663\u0664", "\u24d0"]
    df = spark.createDataFrame(list(enumerate([*texts, "\u00aa", "ka\u00b2ro"])), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(len(texts)))
    assert got[len(texts)][0] != "und" and got[len(texts) + 1][0] == "xx"
    import unicodedata

    for c in map(chr, range(0x3000)):
        assert bool(langid.words_of(c)) == (unicodedata.category(c)[0] == "L"), hex(ord(c))


def test_fit_takes_runs_of_whole_texts(spark):
    text = " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'klmnopqrst'[i // 1000]}" for i in range(9000))
    df = spark.createDataFrame([(text, "xx"), ("ka ro", "yy"), ("", "zz")], "text string, lang string")
    rows = [r for r in df.mapInArrow(langid.cut, "lang string, words array<string>").collect()]
    words = text.split()
    places = [words.index(r["words"][0]) for r in rows if r["lang"] == "xx"]
    assert len(places) == langid.RUNS and places == sorted(places) and places[-1] > 8000
    assert [r["words"] for r in rows if r["lang"] != "xx"] == [["ka", "ro"]]


def test_query_agrees_with_brute_force(spark, corpus, model, tmp_path):
    """The registered query on a small folder, held against one plain forward-backward pass over each text."""
    extra = [(900, None, "xx", "s"), (901, "\u00b2 12", None, "s"), (902, "karo " * 300 + "schung " * 200, None, None)]
    docs = corpus.union(spark.createDataFrame(extra, corpus.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_language(spark, str(tmp_path)).collect()}
    own = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet").where(crc_mod("doc_id", 4) != 2))
    folds = {r[0]: r[1] for r in docs.select("doc_id", crc_mod("doc_id", 4) == 2).collect()}
    for r in docs.collect():
        words = langid.words_of(r["text"] or "")
        row = got[r["doc_id"]]
        assert row["held_out"] == folds[r["doc_id"]]
        if not words:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        e = []
        for w in words:
            feature, _ = langid.features([w])
            mean = own.weights[feature].astype(float).mean(0) * 4
            e.append(np.exp(np.clip(mean - mean.max(), -25, 0)))
        forward, a = [], np.full(3, 1 / 3)
        for x in e:
            a = langid.unit((a @ own.moves) * x)
            forward.append(a)
        b, share = np.full(3, 1 / 3), np.zeros(3)
        for w, x, f in zip(reversed(words), reversed(e), reversed(forward), strict=True):
            share += langid.unit(f * b) * len(w)
            b = langid.unit(own.moves @ (x * b))
        share /= share.sum()
        assert row["lang_pred"] == own.langs[share.argmax()] and row["score"] == pytest.approx(share.max(), abs=1e-6)
    assert len(got) == docs.count()
