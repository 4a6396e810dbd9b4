"""Byte-level BPE, encoded and decoded by DuckDB queries inside each Spark task.

Words (the matches of the pattern) are dictionary-coded in each task. A recursive query holds the
token-position rows of the words not met before, joins neighbouring positions with the merge
table and contracts each word's leftmost pair of the lowest rank until none is left. Documents'
ids are gathered from their words' ids with numpy; an ordered aggregation over each document's
ids, joined with the vocabulary, turns them back into bytes.

The contraction of a pair is chosen exactly as the public BPE libraries choose it, also where a
rank file isn't monotone, so the ids are the same as theirs. Long words are first cut wherever no
token of the vocabulary lies across in the word, as no merge reaches over such a place; of what
is left a round contracts all pairs of the lowest rank, from the left, as far as none of the
contractions makes a pair of that rank or a lower one with its new neighbours.

Cases: a null text counts as empty and has no ids; rows repeat as they are; ids may be null; an
empty table gives an empty table; other columns of the input aren't looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelflow.llm.common import SLICE_BYTES, tidied

#: Words, and their bytes, that a task keeps in its dictionary; when more are met, it starts afresh.
KEEP_WORDS, KEEP_BYTES = 400_000, 32 << 20
#: Bytes of a word that is cut and contracted in rounds of ranks.
LONG = 200
#: Ids that the decoding query joins to one value (their numbers take 16 bits), and that it takes at a time, about.
RUN_IDS, DECODE_IDS = 1 << 14, 1 << 17
#: Words contracted by one recursive query.
QUERY_WORDS = 60_000

CONTRACT = """
WITH RECURSIVE state(w, ids) USING KEY (w) AS (
  SELECT w, list(t ORDER BY p) FROM positions GROUP BY w
  UNION ALL
  SELECT s.w, s.ids[:spot - 1] || [merged] || s.ids[spot + 2:]
  FROM state s JOIN (
    SELECT w, (best & 4294967295)::INT AS spot, (best >> 32)::INT AS merged
    FROM (
      SELECT w, min((m.merged::BIGINT << 32) | p) AS best
      FROM (
        SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, generate_subscripts(ids[2:], 1) AS p
        FROM state
      ) AS n JOIN merges m ON m.l = n.l AND m.r = n.r
      GROUP BY w
    )
  ) AS c ON c.w = s.w
)
SELECT w, ids FROM state ORDER BY w
"""

# A run of pairs of the same rank overlaps: every other one of it is contracted, from the left, up to
# the first whose token has a pair of its own rank or a lower one with its neighbour.
CONTRACT_LONG = """
WITH RECURSIVE state(w, ids) USING KEY (w) AS (
  SELECT w, list(t ORDER BY p) FROM positions GROUP BY w
  UNION ALL
  SELECT w, list(if(taken, best, t) ORDER BY p) FILTER (WHERE NOT coalesce(gone, false))
  FROM (
    SELECT w, p, t, best, taken, lag(taken) OVER (PARTITION BY w ORDER BY p) AS gone
    FROM (
      SELECT e.w, e.p, e.t, e.best, e.pick AND e.p <= coalesce(min(if(e.pick AND (a.merged <= e.best OR b.merged <= e.best), e.p, NULL)) OVER (PARTITION BY e.w), e.p) AS taken
      FROM (
        SELECT *, if(coalesce(lag(pick, 2) OVER o, false), best, lag(t) OVER o) AS before, lead(t, 2) OVER o AS after
        FROM (
          SELECT *, hit AND (p - max(if(hit, NULL, p)) OVER (PARTITION BY w ORDER BY p)) % 2 = 1 AS pick
          FROM (
            SELECT w, p, t, best, coalesce(merged = best, false) AS hit
            FROM (
              SELECT n.w, n.p, n.t, m.merged, min(m.merged) OVER (PARTITION BY n.w) AS best
              FROM (
                SELECT w, unnest([-1] || ids) AS t, unnest(ids || [-1]) AS r, generate_subscripts([-1] || ids, 1) - 1 AS p FROM state
              ) AS n LEFT JOIN merges m ON m.l = n.t AND m.r = n.r
            ) WHERE best IS NOT NULL
          )
        ) WINDOW o AS (PARTITION BY w ORDER BY p)
      ) AS e LEFT JOIN merges a ON e.pick AND a.l = e.before AND a.r = e.best LEFT JOIN merges b ON e.pick AND b.l = e.best AND b.r = e.after
    )
  ) WHERE p > 0 GROUP BY w
)
SELECT w, ids FROM state ORDER BY w
"""

DECODE = """
SELECT k, array_to_string(list(spelled ORDER BY p), '') AS spelled
FROM (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1)::USMALLINT AS p FROM sequences) AS t
JOIN vocabulary USING (id)
GROUP BY k ORDER BY k
"""


def load_ranks(path: str) -> bytes:
    """The rank file's bytes; its size is fixed by the public vocabulary (under 1 MB here)."""
    with open(path, "rb") as f:
        return f.read()


def word_pattern(pattern: str):
    """The pattern compiled with Unicode's White_Space for \\s, as the public libraries read it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Coder:
    """A task's dictionary of words, and its DuckDB tables of merges and vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        import duckdb

        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        merges = [
            (rank[token[:i]], rank[token[i:]], r)
            for token, r in rank.items()
            for i in range(1, len(token))
            if token[:i] in rank and token[i:] in rank
        ]
        left, right, merged = (np.array(x, np.int32) for x in zip(*merges, strict=True))
        self.rank, self.find = rank, word_pattern(pattern).findall
        self.lying = None
        self.every = np.sort(np.fromiter(rank.values(), np.int32))
        self.byte_id = np.array([rank[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.db.register("m", pa.table({"l": left, "r": right, "merged": merged}))
        self.db.register("v", pa.table({"id": pa.array(rank.values(), pa.int32()), "spelled": [t.decode("latin-1") for t in rank]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocabulary AS SELECT * FROM v")
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.bytes = 0
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def parts(self, word: bytes) -> list[bytes]:
        """The word, cut wherever no token of the vocabulary lies across."""
        import ahocorasick

        if self.lying is None:
            self.lying = ahocorasick.Automaton()
            for token in self.rank:
                if len(token) > 1:
                    self.lying.add_word(token.decode("latin-1"), len(token))
            self.lying.make_automaton()
        across = np.zeros(len(word) + 1, np.int64)
        for last, size in self.lying.iter(word.decode("latin-1")):
            across[last - size + 2] += 1  # the first place inside the token, and the first behind it
            across[last + 1] -= 1
        cuts = np.flatnonzero(np.cumsum(across)[1:-1] == 0) + 1
        return [word[i:j] for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)], strict=True)]

    def rounds(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that aren't tokens themselves, one word after the other, and each word's count."""
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), QUERY_WORDS):
            part = words[at : at + QUERY_WORDS]
            size = np.fromiter(map(len, part), np.int64, len(part))
            start = np.repeat(np.cumsum(size) - size, size)
            positions = pa.table(
                {
                    "w": np.repeat(np.arange(len(part), dtype=np.int32), size),
                    "p": (np.arange(len(start)) - start).astype(np.int32),
                    "t": self.byte_id[np.frombuffer(b"".join(part), np.uint8)],
                }
            )
            self.db.register("positions", positions)
            ids = self.db.sql(query).to_arrow_table().column("ids").combine_chunks()
            flat.append(ids.flatten().to_numpy())
            counts.append(ids.value_lengths().to_numpy())
        return np.concatenate(flat), np.concatenate(counts)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where in them each word's begin and how many they are."""
        whole = np.fromiter((self.rank.get(w, -1) for w in words), np.int32, len(words))
        starts, counts = np.arange(len(words)), np.ones(len(words), np.int64)
        several = np.flatnonzero(whole < 0).tolist()
        short = [i for i in several if len(words[i]) < LONG]
        ids, n = self.rounds([words[i] for i in short], CONTRACT)
        starts[short], counts[short] = len(whole) + np.cumsum(n) - n, n
        flat, end = [whole, ids], len(whole) + len(ids)
        cut = {i: self.parts(words[i]) for i in several if len(words[i]) >= LONG}
        if cut:
            pieces = sorted({x for xs in cut.values() for x in xs})
            found = {x: np.array([self.rank[x]], np.int32) for x in pieces if x in self.rank}
            pieces = [x for x in pieces if x not in found]
            ids, n = self.rounds(pieces, CONTRACT_LONG)
            found |= zip(pieces, np.split(ids, np.cumsum(n)[:-1]), strict=False)
            for i, xs in cut.items():
                joined = np.concatenate([found[x] for x in xs])
                starts[i], counts[i], end = end, len(joined), end + len(joined)
                flat.append(joined)
        return np.concatenate(flat), starts, counts

    def bytes_of(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each id sequence; long ones are aggregated in runs, and the runs joined."""
        if not np.isin(flat, self.every).all():
            raise ValueError("an id isn't in the vocabulary")
        runs = -(-counts // RUN_IDS)
        nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        offsets = np.append(np.repeat(np.cumsum(counts) - counts, runs) + nth * RUN_IDS, len(flat)).astype(np.int32)
        found, at = [], 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODE_IDS, "right")) - 1)
            lists = pa.ListArray.from_arrays(pa.array(offsets[at : to + 1] - offsets[at]), pa.array(flat[offsets[at] : offsets[to]]))
            self.db.register("sequences", pa.table({"k": np.arange(to - at, dtype=np.int32), "ids": lists}))
            found += self.db.sql(DECODE).to_arrow_table().column("spelled").to_pylist()
            at = to
        ends = np.cumsum(runs).tolist()
        return ["".join(found[j - n : j]).encode("latin-1") for j, n in zip(ends, runs.tolist(), strict=True)]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.code]
        if not new:
            return
        spelled = [w.encode() for w in new]
        flat, starts, counts = self.contract(spelled)
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.bytes += sum(map(len, spelled))
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])

    def gather(self, texts: list[str]) -> tuple[pa.ListArray, pa.Array]:
        """Ids of each text, and the bytes that they decode to."""
        words = [self.find(x) for x in texts]
        if len(self.code) > KEEP_WORDS or self.bytes > KEEP_BYTES:
            self.clear()
        self.learn(set().union(*words))
        each = [len(ws) for ws in words]
        code = np.fromiter(map(self.code.__getitem__, chain.from_iterable(words)), np.int32, sum(each))
        n = self.counts[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[code] - ends[:-1], n) + np.arange(ends[-1])]
        words_end = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        offsets = ends[words_end]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(self.bytes_of(ids, np.diff(offsets)), pa.binary())


def slices(texts: pa.ChunkedArray | pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about most characters: the first one's index, and the texts (null: empty)."""
    at, held, size = 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


_CODERS: dict[tuple[int, str], Coder] = {}


def coder(ranks: bytes, pattern: str) -> Coder:
    """This Python worker's coder; a worker keeps its dictionary from task to task."""
    key = (hash(ranks), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def round_trip(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): each text's token ids, and the bytes that the ids decode to.

    A narrow operation: no shuffle, and a failed task is simply run again. A task holds a few MB
    of text (or one longer text) and a dictionary of bounded size.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value, pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, decoded = own.gather(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids, decoded], names=[id_col, "ids", "decoded"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return df.select(id_col, text_col).mapInArrow(tidied(run), schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's token ids."""
    return round_trip(df, ranks, pattern, id_col, text_col).drop("decoded")


def decode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of each id sequence; null or empty ids give empty bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                lists = [x or [] for x in part.column(1).to_pylist()]
                counts = np.array([len(x) for x in lists], np.int64)
                flat = np.fromiter((y for x in lists for y in x), np.int32, counts.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.bytes_of(flat, counts), pa.binary())], names=[id_col, "decoded"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])
    return df.select(id_col, ids_col).mapInArrow(tidied(run), schema)


def public_ranks(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Ranks and pattern of the installed public vocabulary."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
