"""Toxicity scores from a learned lexicon, matched through Levenshtein automata.

Training (on at most `per_class` labelled rows of each class, the bound of the fit): words and word
stems that occur far more often in toxic documents become the lexicon. It is held as a trie; the
automaton of all strings within one or two edits of a whole word of it (a swap of neighbours is one) is
intersected with it lazily, as a deterministic automaton whose states are sets of (trie node, edits
spent). A word is run through it character by character, and most words leave it after two or three.
Stems stand for many words as they are, and are matched without edits.

A misspelled form has the weight of the likeliest of the terms that it may spell: the term's own,
less EDIT for each edit, moved by what the training rows say of the term's other forms and of this one;
forms that come out below LEAST are no hits. So exact and misspelled hits add up to one strength. A hit's
context window then says how much it counts: one in quotation marks or beside words of reporting
counts for `quoted` of itself (QUOTED_PRIOR, moved by the training rows' hits in quotation), and
words of address beside hits raise the score. A logistic model over these gives the score; it is learned
from the training rows around a stated prior (PRIOR), and strength never lowers a score.

Every term above the support threshold is in the lexicon, and every form of one that the training
rows hold is judged by itself: both are bounded by the rows of the fit. Cases: a null or empty text has no hit and gets the model's lowest score; rows repeat as they
are; without labels of both classes every score is 0; an empty table gives an empty one; labels
that are null or have no document aren't used; of contradicting labels, of one id or of equal
texts, the higher counts; apostrophes are no quotation marks; other columns aren't looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import bounded_sample, shared_dir, tidied, written

TOKEN = re.compile(r"[^\W_](?:[*@$#!]?[^\W_])*")
WINDOW = 6
#: A quotation on one line; single marks open behind a blank and close before one, others are apostrophes.
QUOTED = re.compile(r"""\"[^"\n]*\"|“[^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|(?<!\w)['‘](?=\S)(?:[^'‘’\n]|(?<=\w)['’](?=\w))*(?<=\S)['’](?!\w)""")
# Words of reporting and of address in the corpus's languages.
REPORTING = frozenset("said says wrote quote quoted called calls word term dit écrit cité mot sagte schrieb zitat wort dijo escribió cita palabra".split())
ADDRESS = frozenset("you your you're are tu toi vous es êtes du dich ihr bist eres usted vos".split())
KEEP_WORDS = 300_000
STEMS = range(4, 8)
#: Forms of a term that its own weight counts for, what an edit takes from it, and the least weight of a misspelled hit.
OWN_FORMS, EDIT, LEAST = 6.0, 1.0, 1.5
#: Half the likelihood ratio that a term of the lexicon has at least.
EVIDENCE = 9.0
#: What a quoted hit counts for, and for how many hits of the training rows that stands.
QUOTED_PRIOR, QUOTED_HITS = 0.1, 5.0


def allowed(term: str, stem: bool) -> int:
    """Edits that a term may differ by."""
    return 0 if len(term) < 5 or stem else 1 if len(term) < 10 else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie; states are made when met."""

    def __init__(self, terms: dict[str, bool]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.stem = {t for t, is_stem in terms.items() if is_stem}
        self.most = max((allowed(t, s) for t, s in terms.items()), default=0)
        for term in terms:
            node = 0
            for ch in term:
                if ch not in self.children[node]:
                    self.children.append({})
                    self.children[node][ch] = len(self.children) - 1
                node = self.children[node][ch]
            self.ends[node] = term
        self.letters = {ch for t in terms for ch in t}
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.final: list[tuple[int, str] | None] = []
        self.prefix: list[tuple[int, str] | None] = []
        self.hits: list[list[tuple[int, str]]] = []
        self.start = self.state({(0, 0, "")})

    def state(self, items: set[tuple[int, int, str]]) -> int:
        """items: (node, edits spent, letter that must come next for a swap to be one, or "")."""
        todo = [x for x in items if not x[2]]
        while todo:  # a letter of the term that the word lacks
            node, spent, _ = todo.pop()
            if spent < self.most:
                for child in self.children[node].values():
                    if (child, spent + 1, "") not in items:
                        items.add((child, spent + 1, ""))
                        todo.append((child, spent + 1, ""))
        key = frozenset(items)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(spent, term) for node, spent, swap in key if not swap and (term := self.ends.get(node)) is not None and spent <= allowed(term, term in self.stem)]
            self.hits.append(hits)
            self.final.append(min((h for h in hits if h[1] not in self.stem), default=None))
            self.prefix.append(min((h for h in hits if h[1] in self.stem), default=None))
        return self.ids[key]

    def step(self, state: int, ch: str) -> int:
        """The next state, or -1 where no term can be reached."""
        out: set[tuple[int, int, str]] = set()
        for node, spent, swap in self.sets[state]:
            if swap:
                if ch == swap:
                    out.add((node, spent, ""))
                continue
            if ch in self.children[node]:
                out.add((self.children[node][ch], spent, ""))
            if spent < self.most:
                out.add((node, spent + 1, ""))
                out.update((child, spent + 1, "") for child in self.children[node].values())
                out.update((self.children[child][ch], spent + 1, first) for first, child in self.children[node].items() if first != ch and ch in self.children[child])
        return self.state(out) if out else -1

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term that the word spells, or whose stem it begins with."""
        state, best, letters = self.start, None, self.letters
        for ch in word:
            ch = ch if ch in letters else ""
            found = self.moves[state].get(ch)
            if found is None:
                found = self.moves[state][ch] = self.step(state, ch)
            state = found
            if state < 0:
                return best
            if (hit := self.prefix[state]) is not None and (best is None or hit < best):
                best = hit
        hit = self.final[state]
        return hit if hit is not None and (best is None or hit < best) else best

    def near(self, word: str) -> dict[str, int]:
        """Each term that the word spells, or whose stem it begins with, and the edits between them."""
        state, found = self.start, {}
        for i, ch in enumerate(word, 1):
            ch = ch if ch in self.letters else ""
            after = self.moves[state].get(ch)
            if after is None:
                after = self.moves[state][ch] = self.step(state, ch)
            state = after
            if state < 0:
                break
            for spent, term in self.hits[state]:
                if term in self.stem or i == len(word):
                    found[term] = min(spent, found.get(term, spent))
        return found


@dataclass
class Model:
    """Weights of terms, of misspelled forms seen in training, and of other forms by term and edits; the logistic model; what quoted hits count for."""

    terms: dict[str, bool] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    forms: dict[str, float] = field(default_factory=dict)
    unseen: dict[tuple[str, int], float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=list)
    quoted: float = QUOTED_PRIOR


class Matcher:
    """A worker's automaton, with the words it has met."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms)
        self.known: dict[str, tuple[float, bool] | None] = {}

    def word(self, word: str) -> tuple[float, bool] | None:
        """(weight, is exact) of a hit."""
        found = self.automaton.match(word)
        if not found:
            return None
        spent, term = found
        if not spent:
            return self.model.weights[term], True
        weight = self.model.forms.get(word)
        if weight is None:
            weight = max(self.model.unseen[term, spent] for term, spent in self.automaton.near(word).items())
        return (weight, False) if weight >= LEAST else None

    def hits(self, text: str) -> tuple[list[tuple[float, bool, bool]], int]:
        """(weight, quoted, addressed) of each hit; the number of words."""
        lowered = text.lower()
        words = TOKEN.findall(lowered)
        known = self.known
        if len(known) > KEEP_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        at = [i for i, hit in enumerate(map(known.__getitem__, words)) if hit]
        if not at:
            return [], len(words)
        spans, quotations = [m.span() for m in TOKEN.finditer(lowered)], [m.span() for m in QUOTED.finditer(lowered)]
        opened, out = [a for a, _ in quotations], []
        for i in at:
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            q = bisect_right(opened, spans[i][0]) - 1
            inside = q >= 0 and quotations[q][1] >= spans[i][1]
            out.append((known[words[i]][0], inside or any(w in REPORTING for w in near), any(w in ADDRESS for w in near)))
        return out, len(words)

    def features(self, text: str) -> list[float]:
        return featured(*self.hits(text), self.model.quoted)


def featured(hits: list[tuple[float, bool, bool]], words: int, quoted: float) -> list[float]:
    """Strength of the hits, their share in address, and their share of the words; quoted hits count for so much each."""
    if not hits:
        return [0.0] * 3
    counts = [quoted if q else 1.0 for _, q, _ in hits]
    strength = sum(w * c for (w, _, _), c in zip(hits, counts, strict=True))
    addressed = sum(c for (_, _, a), c in zip(hits, counts, strict=True) if a) / len(hits)
    return [math.log1p(strength), addressed, math.log1p(100 * sum(counts) / words)]


#: What the logistic model is drawn to where the rows say nothing: the intercept and the features.
PRIOR = np.array([-3.0, 2.0, 0.3, 0.5])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's steps to the coefficients that are likeliest under PRIOR; strength and share never count against a row."""
    x = np.column_stack([np.ones(len(x)), x])
    w, shrink, free = PRIOR.copy(), 0.5, np.ones(len(PRIOR), bool)

    def worth(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (y * z - np.logaddexp(0, z))).sum() - shrink / 2 * ((w - PRIOR) ** 2).sum())

    while True:
        now = worth(w)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (weight * (y - p)) - shrink * (w - PRIOR)
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w))
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            while (then := worth(w + step)) < now and np.abs(step).max() > 1e-9:
                step /= 2
            if then - now < 1e-9:
                break
            w, now = w + step, then
        below = free & (w < 0) & np.array([False, True, True, True])
        if not below.any():
            return w
        w[below], free[below] = 0.0, False


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled documents; pass only labels that may be learned from.

    per_class: documents of each class that the fit looks at, about.
    """
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__toxic"))
    held = one.groupBy("__toxic").count().collect()  # a row for each class
    total = {r["__toxic"]: r["count"] for r in held}
    if len(total) < 2:
        return Model()
    chosen = F.broadcast(bounded_sample(one, "__id", "__toxic", per_class))  # about 2 * per_class rows of two numbers
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(chosen, "__id").select("text", F.col("__toxic").alias("toxic")).where("text is not null")
    sample = written(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), shared_dir(docs.sparkSession), "sample")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = TOKEN.findall(text.as_py().lower())
                before = dict(zip(reversed(words), reversed(["", *words[:-1]]), strict=True))
                stems = {w[:n]: b for w, b in before.items() for n in STEMS if len(w) > n}
                n = len(before) + len(stems)
                yield pa.RecordBatch.from_arrays([pa.array([*before, *stems], pa.string()), pa.array([False] * len(before) + [True] * len(stems)), pa.array([*before.values(), *stems.values()], pa.string()), pa.array([toxic] * n, pa.int32())], names=["term", "stem", "before", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model()
    # a term counts once for each word it follows: copies and shared passages add nothing
    counted = sample.select("text", F.col("toxic").cast("int")).mapInArrow(terms, "term string, stem boolean, before string, toxic int")
    counted = counted.groupBy("term", "stem", "before").agg(F.max("toxic").alias("bad"), F.min("toxic").alias("good")).groupBy("term", "stem").agg(F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("good") == 0).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n1 + 1.0)) - F.log((F.col("good") + 0.5) / (n0 + 1.0))
    counted = counted.withColumn("odds", odds)
    # how surely the term parts the classes: the likelihood ratio of its own share of toxic documents to theirs
    both, toxic_share = F.col("bad") + F.col("good"), n1 / (n1 + n0)
    sure = F.col("bad") * F.log(F.col("bad") / (both * toxic_share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - toxic_share)))).otherwise(0.0)
    support = max(3, round(0.004 * n1))
    found = counted.where((F.col("bad") >= support) & (F.col("odds") >= 2.5) & (sure >= EVIDENCE)).orderBy(F.desc(F.col("bad") * F.col("odds")), "term", "stem").collect()  # a few thousandths of the sample's words at most

    stems = {r["term"]: r for r in found if r["stem"]}
    words = {r["term"]: r for r in found if not r["stem"]}
    model = Model()
    # a stem stands for its words where none of them alone carries most of its documents
    for stem in sorted(stems, key=lambda s: (len(s), s)):
        if any(stem[:n] in model.terms for n in STEMS if n < len(stem)):
            continue
        if max((r["bad"] for w, r in words.items() if w.startswith(stem)), default=0) < 0.5 * stems[stem]["bad"]:
            model.terms[stem], model.weights[stem] = True, float(stems[stem]["odds"])
    for word, r in words.items():
        if not any(word[:n] in model.terms for n in STEMS):
            model.terms[word], model.weights[word] = False, float(r["odds"])

    # misspelled forms: what the training rows say of each, and of each term's forms together
    lexicon = Model(terms=model.terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon.terms)
        for batch in batches:
            hits = [bool((m := automaton.match(w)) and m[0]) for w in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(hits, pa.bool_()))
            of = [list(automaton.near(w).items()) for w in batch.column(0).to_pylist()]
            lists = pa.array([[{"of": t, "spent": n} for t, n in x] for x in of], pa.list_(pa.struct([("of", pa.string()), ("spent", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "terms"])

    forms = counted.where("not stem").select("term", "bad", "good").mapInArrow(near, "term string, bad long, good long, terms array<struct<of: string, spent: int>>")
    forms = written(forms, shared_dir(docs.sparkSession), "forms")
    rows = forms.select("term", "bad", "good", "terms").collect()  # words of the sample
    # a form counts once, however frequent: frequent words say nothing of one that isn't there
    toxic = F.col("bad") / n1 / (F.col("bad") / n1 + F.col("good") / n0)
    kinds = forms.select(toxic.alias("toxic"), F.explode("terms").alias("t")).groupBy("t.of", "t.spent").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    held = {(r["of"], r["spent"]): (r["bad"], r["good"]) for r in kinds.collect()}  # at most two rows for each term
    for term, stem in model.terms.items():
        for spent in range(1, allowed(term, stem) + 1):
            bad, good = held.get((term, spent), (0.0, 0.0))
            prior = 1 / (1 + math.exp(-(model.weights[term] - EDIT * spent)))
            model.unseen[term, spent] = math.log((bad + OWN_FORMS * prior) / (good + OWN_FORMS * (1 - prior)))
    for r in rows:  # a form of the sample: what it says itself, beside what its terms say of forms like it
        prior = 1 / (1 + math.exp(-max(model.unseen[t["of"], t["spent"]] for t in r["terms"])))
        model.forms[r["term"]] = math.log((r["bad"] + 2 * prior) / (r["good"] * n1 / n0 + 2 * (1 - prior)))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            found = [matcher.hits(t.as_py()) for t in batch.column(0)]
            rows = pa.array([[{"w": w, "q": q, "a": a} for w, q, a in h] for h, _ in found], pa.list_(pa.struct([("w", pa.float64()), ("q", pa.bool_()), ("a", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([rows, pa.array([n for _, n in found], pa.int64()), batch.column(1)], names=["hits", "n", "y"])

    found = written(sample.select("text", F.col("toxic").cast("int")).mapInArrow(hits, "hits array<struct<w: double, q: boolean, a: boolean>>, n long, y int"), shared_dir(docs.sparkSession), "hits")
    # rows with quoted hits and no other, by class: how far quotation speaks for a row
    alone = found.where((F.size("hits") > 0) & F.forall("hits", lambda h: h["q"])).groupBy("y").count().collect()
    only = {r["y"]: r["count"] for r in alone}
    bad, good = only.get(1, 0) / n1, only.get(0, 0) / n0
    if bad + good > 0:
        rows_seen = only.get(1, 0) + only.get(0, 0)
        model.quoted = (QUOTED_PRIOR * QUOTED_HITS + rows_seen * bad / (bad + good)) / (QUOTED_HITS + rows_seen)
    strength = lambda w, q: F.when(q, w * model.quoted).otherwise(w)
    zero = F.lit(0.0)
    add = lambda f: F.aggregate("hits", zero, lambda a, h: a + f(h))
    one_hit = F.lit(1.0)
    x = F.array(
        F.log1p(add(lambda h: strength(h["w"], h["q"]))),
        F.when(F.size("hits") > 0, add(lambda h: F.when(h["a"], strength(one_hit, h["q"])).otherwise(0.0)) / F.size("hits")).otherwise(0.0),
        F.when(F.size("hits") > 0, F.log1p(100 * add(lambda h: strength(one_hit, h["q"])) / F.col("n"))).otherwise(0.0),
    )
    rows = found.select(x.alias("x"), "y").collect()  # three numbers for each sampled row
    rows = sorted((r["x"], r["y"]) for r in rows)  # sums in one order, whatever the tasks'
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    weight = np.where(y == 1, total[1] / n1, total[0] / n0)
    model.coef = logistic(x, y, weight * len(y) / weight.sum()).tolist()
    return model


def score(df: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row: a narrow operation."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        matcher = Matcher(own) if own.coef else None
        for batch in batches:
            if matcher:
                x = np.array([[1.0, *matcher.features(t.as_py() or "")] for t in batch.column(1)]).reshape(-1, len(PRIOR))
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(own.coef), -30, 30)))
            else:
                p = np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return df.select(id_col, text_col).mapInArrow(tidied(run), schema)


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        matcher = Matcher(own) if own.coef else None
        for batch in batches:
            if matcher:
                z = np.array([[1.0, *matcher.features(t.as_py() or "")] for t in batch.column(at)]).reshape(-1, len(PRIOR)) @ np.array(own.coef)
                batch = batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))
            yield batch

    return df.mapInArrow(tidied(run), df.schema)
