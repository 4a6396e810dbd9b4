"""Language of each word and text, by a linear-chain conditional random field.

A word's emission is the mean of learned weights of its character n-grams, its affixes (the
n-grams with a word boundary) and itself (the lexicon feature), times four; the weights are hashed
to a table of fixed size. Learned transitions, a distribution over the next word's language for
each language, tie neighbouring words. Forward-backward gives each word's distribution; a text's
language has the largest share of its letters. Training joins runs of words of different
documents, so that the transitions see switches. The fit looks at `per_lang` documents of each
language, and of each at no more than `RUNS` runs, dealt evenly over the whole text. Languages with
fewer words are gone over again until all have about as many.

Words are runs of letters (Unicode's category L): figures, superscripts, fractions and Roman
numeral signs are none.

In a task, forward-backward runs over all words of a slice of texts at once: blocks of words are
multiplied out side by side, carried over the blocks of each text, and then filled in. The
result is that of one pass over each whole text, however long.

Cases: a null text, or one without a letter, is `und` with score 0; without labelled rows all
are; rows repeat as they are; null labels aren't used; an empty table gives an empty one; other
columns aren't looked at.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.bpe import slices
from panelflow.llm.common import bounded_sample, tidied

WORD = re.compile(r"[^\W\d_]+")
#: What WORD takes besides letters.
NUMERALS = {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
NUMERAL_SIGNS = frozenset(map(chr, NUMERALS))
#: Runs of words that the fit takes of a document at most, and their least and largest numbers of words.
RUNS, RUN_WORDS = 24, (8, 64)
BITS = 17
BLOCK = 64
KEEP_WORDS = 300_000
#: Letters that forward-backward takes at a time, about.
SLICE = 2 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    text = text.lower()
    plain = text.isascii() or NUMERAL_SIGNS.isdisjoint(text)
    return WORD.findall(text if plain else text.translate(NUMERALS))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs: hashed n-grams of one to four letters, boundaries included, and the word."""
    text = "".join(f"^{w}$" for w in words)
    char = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), size)
    grams, owner = [], []
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if len(char) < n:
                break
            h = np.full(len(char) - n + 1, np.uint64(n), np.uint64)
            for k in range(n):
                h = (h ^ char[k : len(char) - n + 1 + k]) * ODD[k]
                h ^= h >> np.uint64(29)
            whole = of[: len(h)] == of[n - 1 :]
            grams.append(((h * ODD[0]) >> shift)[whole])
            owner.append(of[: len(h)][whole])
        start = np.cumsum(size) - size
        place = (np.arange(len(char)) - np.repeat(start, size)).astype(np.uint64)
        spelled = (char + place * ODD[2]) * ODD[1]
        spelled ^= spelled >> np.uint64(31)
        h = np.add.reduceat(spelled * ODD[3], start) if len(words) else np.zeros(0, np.uint64)
        grams.append((h * ODD[0]) >> shift)
        owner.append(np.arange(len(words)))
    return np.concatenate(grams).astype(np.int32), np.concatenate(owner)


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    moves: np.ndarray | None = None


def emissions(weights: np.ndarray, feature: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Each word's score of each language: the mean weight of its features, times four."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.stack([np.bincount(owner, weights=weights[feature, k], minlength=n) for k in range(weights.shape[1])], 1) * (4 / count)[:, None]


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(e: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Forward-backward: e has the words' emission factors, text after text of the given sizes (above 0)."""
    n_lang = e.shape[1]
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    # each word's block and place in it
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = first[text_of] + at // BLOCK, at % BLOCK
    grid = np.ones((BLOCK, nb, n_lang))
    real = np.zeros((BLOCK, nb), bool)
    grid[col, row], real[col, row] = e, True

    whole = np.broadcast_to(np.eye(n_lang), (nb, n_lang, n_lang)).copy()
    for t in range(BLOCK):
        on = real[t]
        if not on.any():
            break
        step = (whole[on] @ moves) * grid[t][on][:, None, :]
        whole[on] = step / step.sum((1, 2), keepdims=True)
    enter, leave = np.full((nb, n_lang), 1 / n_lang), np.full((nb, n_lang), 1 / n_lang)
    for k in range(1, int(blocks.max())):
        i = first[blocks > k] + k
        enter[i] = unit(np.einsum("bi,bij->bj", enter[i - 1], whole[i - 1]))
    for k in range(1, int(blocks.max())):
        i = (first + blocks - 1)[blocks > k] - k
        leave[i] = unit(np.einsum("bij,bj->bi", whole[i + 1], leave[i + 1]))
    forward = np.empty_like(grid)
    a = enter
    for t in range(BLOCK):
        a = np.where(real[t][:, None], unit((a @ moves) * grid[t]), a)
        forward[t] = a
    b = leave
    for t in range(BLOCK - 1, -1, -1):
        forward[t] = unit(forward[t] * b)
        b = np.where(real[t][:, None], unit((grid[t] * b) @ moves.T), b)
    return forward[col, row]


def factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(1, keepdims=True), -25, 0))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words): runs of words of each text, of many words at even distances."""
    for batch in batches:
        langs, out = [], []
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.as_py())
            rng, ends = np.random.default_rng(len(words)), [0]
            while ends[-1] < len(words):
                ends.append(ends[-1] + int(rng.integers(*RUN_WORDS)))
            runs = list(zip(ends, ends[1:], strict=False))
            for i in sorted({len(runs) * k // RUNS for k in range(RUNS)}) if runs else []:
                out.append(words[slice(*runs[i])])
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])


def fit(docs: DataFrame, per_lang: int = 120, steps: int = 30, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of about per_lang documents of each language (the bound of the fit); pass only rows that may be learned from."""
    sample = bounded_sample(docs, id_col, lang_col, per_lang).where(F.col(text_col).isNotNull())
    runs = sorted((r["lang"], r["words"]) for r in sample.select(text_col, F.col(lang_col).alias("lang")).mapInArrow(cut, "lang string, words array<string>").collect())
    model = Model(langs=sorted({lang for lang, _ in runs}))
    if not model.langs:
        return model
    number = {lang: i for i, lang in enumerate(model.langs)}
    vocabulary: dict[str, int] = {}
    of = [[np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for lang, words in runs if lang == own] for own in model.langs]
    # runs of many documents, dealt anew: texts that switch between languages
    rng = np.random.default_rng(0)
    most = max(sum(map(len, own)) for own in of)
    dealt = []
    for lang, own in enumerate(of):
        order, held, i = rng.permutation(len(own)), 0, 0
        while held < most:
            dealt.append((own[order[i % len(own)]], lang))
            held, i = held + len(dealt[-1][0]), i + 1
    order = rng.permutation(len(dealt))
    stream = np.concatenate([dealt[i][0] for i in order])
    gold = np.concatenate([np.full(len(dealt[i][0]), dealt[i][1]) for i in order])
    n_lang, n = len(model.langs), len(stream)
    sizes = np.array([min(BLOCK, n - i) for i in range(0, n, BLOCK)])
    starts = np.zeros(n, bool)
    starts[::BLOCK] = True
    feature, owner = features(list(vocabulary))
    per_word = 4 / np.bincount(owner, minlength=len(vocabulary))
    weights, moves = np.zeros((1 << BITS, n_lang)), np.zeros((n_lang, n_lang))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    follows = np.flatnonzero(~starts[1:])
    seen = np.zeros((n_lang, n_lang))
    np.add.at(seen, (gold[follows], gold[follows + 1]), 1)
    for turn in range(1, steps + 1):
        move = unit(np.exp(moves))
        f = factors(emissions(weights, feature, owner, len(vocabulary)))[stream]
        p = marginals(f, move, sizes)
        off = -p
        off[np.arange(n), gold] += 1
        by_word = np.stack([np.bincount(stream, weights=off[:, k], minlength=len(vocabulary)) for k in range(n_lang)], 1) * per_word[:, None] / n
        grad = np.stack([np.bincount(feature, weights=by_word[owner, k], minlength=1 << BITS) for k in range(n_lang)], 1) - 1e-7 * weights
        pair = p[follows][:, :, None] * move[None] * p[follows + 1][:, None, :]
        expected = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        # moves are the logits of each language's distribution over the next
        free = seen - expected
        along = (free - move * free.sum(1, keepdims=True)) / n
        for x, g, (m, v), rate in ((weights, grad, state[0], 0.3), (moves, along, state[1], 0.1)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-10)
    model.weights, model.moves = weights.astype(np.float32), unit(np.exp(moves))
    return model


class Tagger:
    """A worker's model, with the emission factors of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.factors = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0)

    def tag(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, all words' distributions, and all words' numbers of letters."""
        words = [words_of(x) for x in texts]
        if len(self.code) > KEEP_WORDS:
            self.clear()
        new = list(set().union(*words).difference(self.code))
        if new:
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            self.factors = np.concatenate([self.factors, factors(emissions(self.model.weights, *features(new), len(new)))])
            self.letters = np.concatenate([self.letters, [len(w) for w in new]])
        codes = np.fromiter((c for ws in words for c in map(self.code.__getitem__, ws)), np.int64)
        sizes = np.array([len(ws) for ws in words if ws])
        p = marginals(self.factors[codes], self.model.moves, sizes) if len(sizes) else self.factors[:0]
        return words, p, self.letters[codes]

    def texts(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Each text's language and its share of the letters."""
        words, p, letters = self.tag(texts)
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        full = [i for i, ws in enumerate(words) if ws]
        if full:
            start = np.cumsum([0] + [len(words[i]) for i in full])[:-1]
            share = unit(np.add.reduceat(p * letters[:, None], start, axis=0))
            for i, k, s in zip(full, share.argmax(1).tolist(), share.max(1).tolist(), strict=True):
                lang[i], score[i] = self.model.langs[k], min(s, 1.0)
        return lang, score


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row: a narrow operation."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value.langs else None
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                lang, score = tagger.texts(texts) if tagger else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(id_col, text_col).mapInArrow(tidied(run), schema)


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is found: all but those that predict() calls `und`."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    column = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value.langs else None
        for batch in batches:
            for at, texts in slices(batch.column(column), SLICE):
                part = batch.slice(at, len(texts))
                lang = tagger.texts(texts)[0] if tagger else ["und"] * len(texts)
                yield part.filter(pa.array([x != "und" for x in lang], pa.bool_()))

    return df.mapInArrow(tidied(run), df.schema)
