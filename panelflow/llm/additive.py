"""Approximate nearest neighbours by additive quantisation.

Fit (on a bounded sample, `sample_rows`): codebooks are learned one after the other on the residuals
that the codebooks before them leave; vectors of more than WIDTH components are cut to blocks of as
many at most, each with codebooks of its own, so that long vectors get longer codes. Index: every vector is encoded by
beam search, so that the chosen codewords' sum, not each choice by itself, is near; the vector's
norm, as a multiple of the reconstruction's, is stored beside the code. Search: large shards of
codes and norms, a few bytes a row, meet blocks of queries. A query's inner products with all
codewords make a lookup table, once for each block; a vector's score is the sum of its codewords'
entries times the stored norm. The best `rerank` rows of all shards are then joined with their
vectors, scored exactly in double precision, and the k best returned.

How many rows a shortlist needs depends on the vectors (rows in dense groups differ by less than
their codes do), so it is measured: for about PROBES query rows the whole index is searched by brute
force, their nearest rows are placed in the order of approximate scores, and shortlists get as many
rows as hold REACHED of them, `rerank` at least.

Every vector is indexed and every shard searched; only the shortlist is approximate. Cases:
vectors that are null, zero or hold null or non-finite components take no part; equal scores go
to the smaller id; repeated rows are candidates each, and each repeated query row is answered;
with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import joined, shared_dir, written
from panelflow.llm.vectors import FOUND, in_phases, no_rows, numbered, ranked, shard_of, thinned, usable

SHARD_ROWS = 131_072
#: Queries, and rows, that are scored at a time.
QUERIES, ROWS = 64, 16_384
STAGES, WORDS, BEAM = 24, 256, 4
#: Components of a block of codebooks at most.
WIDTH = 64
#: Queries that are also searched by brute force, about, and the share of their nearest rows that shortlists must hold.
PROBES, REACHED = 128, 0.98


@dataclass
class Codebooks:
    """words[m, j]: codeword j of stage m."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The code of each row of x: of the sums of the codewords so far, the `beam` nearest go on from stage to stage."""
        n, dim = x.shape
        every = np.arange(n)
        codes, rest, error = np.zeros((n, 1, 0), np.uint8), x[:, None, :].astype(np.float32), np.zeros((n, 1), np.float32)
        for words in self.words.astype(np.float32):
            # of |rest - word|^2 what the word changes
            total = (rest.reshape(-1, dim) @ (-2 * words.T) + (words**2).sum(1)).reshape(n, -1, len(words))
            total += error[:, :, None]
            flat, picks, least = total.reshape(n, -1), [], []
            for _ in range(min(beam, flat.shape[1])):  # a few smallest: faster one by one than by partition
                picks.append(flat.argmin(1))
                least.append(flat[every, picks[-1]])
                flat[every, picks[-1]] = np.inf
            pick, error = np.stack(picks, 1), np.stack(least, 1)
            came, word = np.divmod(pick, len(words))
            rest = np.take_along_axis(rest, came[:, :, None], 1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        return codes[every, error.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))

    def table(self, queries: np.ndarray) -> np.ndarray:
        """(stage, word, query): the inner products of all codewords."""
        return np.einsum("mjd,qd->mjq", self.words, queries, optimize=True).astype(np.float32)


@dataclass
class Blocks:
    """Codebooks of neighbouring blocks of components; ends: where each block but the last ends."""

    ends: list[int]
    parts: list[Codebooks]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([books.encode(part) for books, part in zip(self.parts, np.split(x, self.ends, 1), strict=True)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        starts = np.cumsum([len(books.words) for books in self.parts])[:-1]
        return np.concatenate([books.decode(part) for books, part in zip(self.parts, np.split(codes, starts, 1), strict=True)], 1)

    def table(self, queries: np.ndarray) -> np.ndarray:
        return np.concatenate([books.table(part) for books, part in zip(self.parts, np.split(queries, self.ends, 1), strict=True)])


def fit(x: np.ndarray, stages: int = STAGES, words: int = WORDS, turns: int = 6, seed: int = 0) -> Codebooks:
    """Codebooks of the sample's residuals, by Lloyd's steps."""
    rng, rest, books = np.random.default_rng(seed), x.astype(np.float32), []

    def nearest_word(book: np.ndarray) -> np.ndarray:
        return ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)

    for _ in range(stages):
        book = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(turns):
            near = nearest_word(book)
            order = np.argsort(near, kind="stable")
            used, start = np.unique(near[order], return_index=True)
            book = rest[rng.integers(len(rest), size=words)]  # for words that no row is nearest to
            book[used] = np.add.reduceat(rest[order], start) / np.diff(start, append=len(rest))[:, None]
        rest = rest - book[nearest_word(book)]
        books.append(book.astype(np.float64))
    return Codebooks(np.array(books))


def fit_blocks(x: np.ndarray) -> Blocks:
    parts = np.array_split(x, -(-x.shape[1] // WIDTH), 1)
    return Blocks(np.cumsum([p.shape[1] for p in parts])[:-1].tolist(), [fit(p) for p in parts])


def stretch(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The vector's norm as a multiple of its reconstruction's: sums of codewords come out too short."""
    return np.sqrt((x**2).sum(1)) / np.maximum(np.sqrt((near**2).sum(1)), 1e-300)


def scores(codes: np.ndarray, norms: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(query, row): each row's sum of its codewords' entries in the queries' table (stage, word, query), times its norm."""
    out = np.empty((table.shape[2], len(codes)), np.float32)
    for at in range(0, len(codes), ROWS):
        part = codes[at : at + ROWS]
        total = table[0][part[:, 0]]
        for m in range(1, len(table)):
            total += table[m][part[:, m]]
        out[:, at : at + ROWS] = (total * norms[at : at + ROWS, None]).T
    return out


def code_matrix(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def shard_search(codebooks: dict[int, Blocks], rerank: int):
    def search(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return no_rows("float64")
        shard = shard.sort_values(["id", "row"])
        row, ids, norms = shard["row"].to_numpy(), shard["id"].to_numpy(), shard["norm"].to_numpy(np.float32)
        codes, books = code_matrix(shard["code"]), codebooks[int(shard["dim"].iloc[0])]
        short, out = min(rerank, len(ids)), []
        for start in range(0, len(queries), QUERIES):
            part = queries.iloc[start : start + QUERIES]
            own, floor = part["id"].to_numpy(), part["floor"].fillna(-np.inf).to_numpy(float)
            got = scores(codes, norms, books.table(np.stack(part["x"]).astype(float)))
            mine = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            for i, (a, b) in enumerate(zip(*mine, strict=True)):
                got[i, a:b] = -np.inf
            for i, line in enumerate(got):
                pick = np.flatnonzero(line >= floor[i])
                if len(pick) > short:
                    pick = pick[np.argpartition(-line[pick], short - 1)[:short]]
                pick = pick[np.isfinite(line[pick])]
                out.append((np.full(len(pick), part["row"].iloc[i]), np.full(len(pick), own[i]), row[pick], ids[pick], line[pick].astype(float)))
        return pd.DataFrame(dict(zip(no_rows("float64").columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return search


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact inner products of the columns x and y, in place of the approximate score."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        if len(batch):
            n = pc.list_value_length(x).to_numpy()
            start = np.cumsum(n) - n
            each = x.flatten().to_numpy().astype(np.float64) * y.flatten().to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "query_id", "row", "vec_id")), pa.array(np.add.reduceat(each, start))], names=["q", "query_id", "row", "vec_id", "score"])


def depth(index: DataFrame, queries: DataFrame, codebooks, k: int) -> int:
    """Rows that a shortlist needs, so that those of the probes hold REACHED of their k nearest rows.

    codebooks: a broadcast of those of each length. The driver gets the probes and k rows for each.
    """
    unit = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1_000_000)) / F.lit(1e6)
    some = queries.where(unit < F.lit(PROBES / max(queries.count(), 1))).select("row", "id", "dim", "x").toPandas()
    probes = {dim: (of["row"].to_numpy(), of["id"].to_numpy(), np.stack(of["x"]).astype(float)) for dim, of in some.groupby("dim")}

    def parts(batches, size: int):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim in probes:
                    for at in range(0, len(part), size):
                        yield dim, part.iloc[at : at + size]

    def exact(batches):
        for dim, part in parts(batches, ROWS):
            row, own, x = probes[dim]
            ids = part["id"].to_numpy()
            got = x @ np.stack(part["x"]).astype(float).T
            got[own[:, None] == ids[None, :]] = -np.inf
            best = np.argpartition(-got, min(k, len(ids)) - 1, 1)[:, :k]
            score, of = np.take_along_axis(got, best, 1), np.broadcast_to(np.arange(len(row))[:, None], best.shape)
            on = np.isfinite(score)
            yield pd.DataFrame({"q": row[of[on]], "query_id": own[of[on]], "row": part["row"].to_numpy()[best[on]], "vec_id": ids[best[on]], "score": score[on]})

    found = ranked(index.select("row", "id", "dim", "x").mapInPandas(exact, FOUND + "double"), k).select("q", "row")
    true = found.join(index.select("row", "dim", "code", "norm"), "row").toPandas()
    if not len(true):
        return 0
    least = {}  # the approximate scores of each probe's nearest rows
    for dim, (row, _, x) in probes.items():
        of = true[true["dim"] == dim]
        got = scores(code_matrix(of["code"]), of["norm"].to_numpy(np.float32), codebooks.value[dim].table(x)) if len(of) else np.zeros((len(row), 0), np.float32)
        least[dim] = [np.sort(got[i, of["q"].to_numpy() == q]) for i, q in enumerate(row)]

    def above(batches):
        count = {dim: [np.zeros(len(x), np.int64) for x in of] for dim, of in least.items()}
        for dim, part in parts(batches, ROWS):
            _, own, x = probes[dim]
            got = scores(code_matrix(part["code"]), part["norm"].to_numpy(np.float32), codebooks.value[dim].table(x))
            ids = part["id"].to_numpy()
            for i, each in enumerate(least[dim]):
                line = np.sort(got[i, ids != own[i]])
                count[dim][i] += len(line) - np.searchsorted(line, each, "left")
        rows = [(dim, i, j, int(n)) for dim, of in count.items() for i, line in enumerate(of) for j, n in enumerate(line)]
        yield pd.DataFrame(rows, columns=["dim", "probe", "place", "n"])

    counts = index.select("id", "dim", "code", "norm").mapInPandas(above, "dim int, probe int, place int, n long")
    places = counts.groupBy("dim", "probe", "place").agg(F.sum("n").alias("n")).select("dim", "n").toPandas()
    return max(int(np.quantile(of, REACHED, method="higher")) for _, of in places.groupby("dim")["n"])


def nearest(df: DataFrame, is_query, k: int = 20, rerank: int = 100, sample_rows: int = 16_384, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row.

    is_query: a condition on the column id. sample_rows: of the fit, about. rerank: rows that are
    scored exactly for each query, at least.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    vectors = numbered(usable(df, id_col, vec_col, zero=False), folder)
    total = vectors.groupBy("dim").count().collect()  # a row for each length of vectors
    codebooks = {}
    for of in total:
        unit = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) / F.lit(1e6)
        own = vectors.where((F.col("dim") == of["dim"]) & (unit < F.lit(sample_rows / of["count"])))
        sample = own.select("x").toPandas()["x"]
        codebooks[of["dim"]] = fit_blocks(np.stack(sample).astype(float) if len(sample) else np.zeros((1, of["dim"])))
    shared = spark.sparkContext.broadcast(codebooks)

    def code(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                books = shared.value[dim]
                for start in range(0, len(part), 1024):
                    rows = part.iloc[start : start + 1024]
                    x = np.stack(rows["x"]).astype(float)
                    codes = books.encode(x)
                    yield pd.DataFrame({"row": rows["row"], "id": rows["id"], "x": rows["x"], "dim": dim, "shard": rows["shard"], "code": [c.tobytes() for c in codes], "norm": stretch(x, books.decode(codes))})

    n = max(1, -(-sum(of["count"] for of in total) // SHARD_ROWS))
    index = thinned(vectors, k).select("row", "id", "x", "dim", shard_of(n))
    kind = index.schema["x"].dataType.simpleString()
    whole = written(index.mapInPandas(code, f"row long, id long, x {kind}, dim int, shard int, code binary, norm double"), folder, "index")
    index, queries = whole.drop("x"), vectors.where(is_query)
    rerank = max(rerank, depth(whole, queries, shared, k))

    def search(shard, queries):
        return shard_search(shared.value, rerank)(shard, queries)

    short = in_phases(index, queries, n, search, "double", rerank, folder).select("q", "query_id", "row", "vec_id")
    # a vector may be in very many shortlists
    pairs = joined(short, vectors.select("row", "x"), "row", folder, "short")
    pairs = pairs.join(queries.select(F.col("row").alias("q"), F.col("x").alias("y")), "q")
    exact = pairs.select("q", "query_id", "row", "vec_id", "x", "y").mapInArrow(products, FOUND + "double")
    return ranked(exact, k).select("query_id", "rank", "vec_id", "score")
