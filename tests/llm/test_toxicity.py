import math
import random

import pytest
from pyspark.sql import functions as F

from panelflow.llm import queries, toxicity
from panelflow.llm.common import crc_mod


def within(a, b, most):
    """Plain edit distance, a swap of neighbours being one edit, for comparison."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                new[-1] = min(new[-1], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1] if rows[-1][-1] <= most else None


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(1)
    terms = {"abcab": False, "bacca": False, "ccbabcabca": False, "abc": False}
    automaton = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        near = [d for t in terms if (d := within(word, t, toxicity.allowed(t, False))) is not None]
        found = automaton.match(word)
        assert (found[0] if found else None) == min(near, default=None), word


def test_stems_match_beginnings():
    automaton = toxicity.Automaton({"lost": True, "idiot": False})
    assert automaton.match("lostrand") == (0, "lost")
    assert automaton.match("idi0t") == (1, "idiot")
    assert automaton.match("losran") is None


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    clean = ["tree", "house", "river", "stone", "cloud", "bread", "paper", "green", "walks", "sings", "slowly"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for bad in rng.sample(["moron", "imbecile", "scoundrel"], 2):
                words.insert(rng.randrange(40), bad if rng.random() < 0.8 else bad.replace("o", "0", 1))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    assert {"moron", "imbecile", "scoundrel"} <= set(model.terms)
    held = toxicity.score(docs, model).join(labels, "doc_id").where(crc_mod("doc_id", 3) == 1).collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97
    clean = toxicity.keep_clean(docs.withColumn("more", F.lit(1)), model)
    assert clean.columns == ["doc_id", "text", "more"]
    assert abs(clean.count() - labels.where("toxic = 0").count()) < 12


def test_quotation_lowers_the_score(corpus):
    model = toxicity.fit(*corpus)
    matcher = toxicity.Matcher(model)
    plain, quoted = matcher.features("the tree moron house"), matcher.features('he wrote "the tree moron house" slowly')
    assert quoted[0] < plain[0] and quoted[2] < plain[2] and min(model.coef[1:]) >= 0
    weight = lambda x: sum(c * v for c, v in zip(model.coef[1:], x, strict=True))
    assert weight(quoted) < weight(plain)


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs, corpus):
    model = toxicity.fit(*corpus)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in got)
    assert toxicity.score(no_docs, model).collect() == []
    none = toxicity.fit(odd_docs, spark.createDataFrame([(1, None), (2, 1), (99, 0), (None, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.0}


def test_unseen_misspellings_are_judged_term_by_term(spark):
    """Many clean words near one noise term don't turn off the misspellings of the others."""
    rng = random.Random(8)
    letters = "abcdefghij"
    clean = [w for a in letters for w in (a + "ortiso", "fo" + a + "tiso", "fort" + a + "so", "fortis" + a) if w != "fortiso"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = [rng.choice(clean) for _ in range(40)], i % 2 == 0
        if toxic:
            for bad in rng.sample(["moron", "imbecile", "fortiso"], 2):
                words.insert(rng.randrange(40), bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"moron", "imbecile", "fortiso"} <= set(model.terms)
    text = " ".join(r[1] for r in rows)
    matcher = toxicity.Matcher(model)
    for word in ("m0ron", "mron", "moronn", "imbecil", "1mbecile", "imbeccile"):
        assert word not in text.split()
        assert matcher.word(word) is not None, word
    assert matcher.word("fortiso") is not None and matcher.word("forxiso") is None


def test_apostrophes_are_no_quotation(corpus):
    matcher = toxicity.Matcher(toxicity.fit(*corpus))
    quoted = lambda text: sum(q for _, q, _ in matcher.hits(text)[0])
    for text in ("you're such a moron and you don't know it", "it\u2019s a moron, isn\u2019t it", "the dogs' moron barks, the cats' too", 'a moron of 5" and more'):
        assert quoted(text) == 0, text
    for text in ("'such a moron'", "they read \u2018a moron\u2019 there", "\u201eein moron\u201c", "\u00ab un moron \u00bb", '"it isn\'t a moron" x', "so 'don't be a moron' ends"):
        assert quoted(text) == 1, text
    assert quoted('"a tree" moron "a house"') == 0


def test_labels_of_equal_texts(spark, corpus):
    """The higher label counts, whatever the order of the rows."""
    docs, labels = corpus
    more = docs.where("doc_id < 40").withColumn("doc_id", docs["doc_id"] + 1000)
    wrong = more.selectExpr("doc_id", "0 toxic").union(labels)
    one = toxicity.fit(docs.union(more), wrong)
    other = toxicity.fit(more.union(docs).repartition(3), wrong.orderBy(F.desc("doc_id")))
    assert one.terms == other.terms and one.coef == pytest.approx(other.coef)
    assert {"moron", "imbecile", "scoundrel"} <= set(one.terms)


def plain_hit(model, word):
    """(weight, exact) by plain edit distances to all terms."""
    near = {}
    for term, stem in model.terms.items():
        most = toxicity.allowed(term, stem)
        ways = [word[:n] for n in range(1, len(word) + 1)] if stem else [word]
        found = [d for w in ways if abs(len(w) - len(term)) <= most and (d := within(w, term, most)) is not None]
        if found:
            near[term] = min(found)
    if not near:
        return None
    spent, term = min((d, t) for t, d in near.items())
    if not spent:
        return model.weights[term], True
    weight = model.forms.get(word, None)
    weight = max(model.unseen[t, d] for t, d in near.items()) if weight is None else weight
    return (weight, False) if weight >= toxicity.LEAST else None


def test_query_agrees_with_brute_force(spark, corpus, tmp_path):
    """The registered query on a small folder of tables, held against plain edit distances and sums."""
    docs, labels = corpus
    extra = [(900, None), (901, ""), (902, "you m0ron"), (903, 'she said "moron" once'), (904, "imbeciles " * 500), (905, "moron")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("lang", F.lit("en"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    folds = {r[0]: r[1] for r in docs.select("doc_id", crc_mod("doc_id", 3) == 1).collect()}
    known = {}
    for r in docs.collect():
        text = (r["text"] or "").lower()
        at = [(m.group(), m.start()) for m in toxicity.TOKEN.finditer(text)]
        x, near = [0.0] * 3, []
        for i, (word, place) in enumerate(at):
            if word not in known:
                known[word] = plain_hit(model, word)
            if known[word]:
                around = [w for w, _ in at[max(0, i - 6) : i] + at[i + 1 : i + 7]]
                quoted = any(m.start() <= place < m.end() for m in toxicity.QUOTED.finditer(text)) or any(w in toxicity.REPORTING for w in around)
                near.append((known[word][0], model.quoted if quoted else 1.0, any(w in toxicity.ADDRESS for w in around)))
        if near:
            x = [math.log1p(sum(w * c for w, c, _ in near)), sum(c for _, c, a in near if a) / len(near), math.log1p(100 * sum(c for _, c, _ in near) / len(at))]
        want = 1 / (1 + math.exp(-sum(c * v for c, v in zip(model.coef, [1.0, *x], strict=True))))
        row = got[r["doc_id"]]
        assert row["score"] == pytest.approx(want, abs=1e-9) and row["held_out"] == folds[r["doc_id"]] and row["predicted"] == (want >= 0.7)
    assert len(got) == docs.count()


# -- on the driver's own corpus ---------------------------------------------------------------------

INSULTS = ["trash", "idiot", "pathetic", "worthless", "stupid", "loser", "moron", "disgusting", "clown"]


@pytest.fixture(scope="module")
def learned(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    held = docs.join(labels.where(crc_mod("doc_id", 3) == 1).where("toxic is not null"), "doc_id").where("text is not null").select("text", "toxic").collect()
    return model, [(r["text"], r["toxic"]) for r in held]


def scorer(model):
    matcher = toxicity.Matcher(model)
    return lambda text: 1 / (1 + math.exp(-sum(c * v for c, v in zip(model.coef, [1.0, *matcher.features(text)], strict=True))))


def respelled(rng, word):
    """One edit: a letter left out, doubled, swapped with the next or replaced by a likeness."""
    i = rng.randrange(1, len(word) - 1)
    kind = rng.randrange(4)
    if kind == 0:
        return word[:i] + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i] + word[i:]
    if kind == 2 and word[i] != word[i + 1]:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + "0" + word[i + 1 :]


def test_misspelled_insults_carry_the_score(learned):
    """In clean held-out prose of 30 and of 100 words, with two insults respelled; without the automaton's edits they go unseen."""
    model, held = learned
    assert set(INSULTS) <= set(model.terms) and min(model.coef[1:]) >= 0
    score, rng = scorer(model), random.Random(5)
    strict = toxicity.Model(model.terms, model.weights, {}, dict.fromkeys(model.unseen, -9.0), model.coef, model.quoted)
    exact_only = scorer(strict)
    clean = [t.split() for t, y in held if not y and len(t.split()) > 120]
    for size in (30, 100):
        found = missed = alarms = 0
        for n in range(200):
            words = rng.choice(clean)[:size]
            alarms += score(" ".join(words)) >= 0.7
            for insult in rng.sample(INSULTS, 2):
                words.insert(rng.randrange(len(words)), respelled(rng, insult))
            found += score(" ".join(words)) >= 0.7
            missed += exact_only(" ".join(words)) >= 0.7
        assert found >= 160 and alarms <= 2 and missed < found - 100, (size, found, missed, alarms)


def test_quoted_insults_are_told_from_abuse(learned):
    model, held = learned
    score, rng = scorer(model), random.Random(6)
    clean = [t.split() for t, y in held if not y and len(t.split()) > 60]
    above = told = 0
    for _ in range(200):
        words, insults = rng.choice(clean)[:30], rng.sample(INSULTS, 2)
        abuse, quote = " ".join([*words[:15], *insults, *words[15:]]), " ".join([*words[:15], "said", '"' + " and ".join(insults) + '"', *words[15:]])
        if score(abuse) >= 0.7:
            above += 1
            told += score(quote) < 0.7
    assert above > 180 and told > 0.95 * above
    assert score("The word idiot comes from Greek.") < 0.7 and score('He said "you are an idiot and a moron" and left.') < 0.7 < score("you are an idiot and a moron")


def test_held_out_rows_of_the_corpus(learned):
    model, held = learned
    score = scorer(model)
    toxic, clean = [score(t) >= 0.7 for t, y in held if y], [score(t) >= 0.7 for t, y in held if not y]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))
