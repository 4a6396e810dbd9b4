"""SimHash fingerprints, linked by a tiled exact comparison.

1. Fingerprints: in each task, words are cut by byte class, shingles hashed with XXH64 and the
   bits counted by numpy.
2. Equal fingerprints collapse to one row (partial aggregation first), so copies never meet.
3. Each distinct fingerprint has a home tile named by the population counts of its two halves,
   and visits those neighbouring tiles whose counts differ by no more than the radius in sum:
   population counts that differ by more can't belong to fingerprints within the radius, so
   those tile pairs are skipped. A tile with more home rows than one task should hold is split,
   and its visitors go to each part. Inside a task, smaller tiles (sorted by population counts)
   are compared by exclusive-or and bit counts, after the same test of their bounds.
4. Links become components by rounds of minimum labels with pointer jumping.

Every pair of distinct fingerprints is either compared or proven to be out of reach; nothing is
capped. Copies in one tile cost one row. The comparison stays quadratic in the number of distinct
fingerprints: the fullest tiles hold about a fiftieth of them, and a fingerprint meets about a
tenth of all others. Cases: a null text, or one without words, has
fingerprint zero and is linked like any other; fewer words than a shingle make one shingle; rows
repeat as they are; an empty table gives an empty one; other columns are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import joined, shared_dir, tasks_for, tidied, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Home rows of a tile that one task compares at most.
TILE_ROWS = 32_768
#: Rows of the small tiles inside a task.
SMALL = 512


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """A bit is one if it is set in over half of the shingles' hashes."""
    import xxhash

    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    if len(words) < width:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in shingles], np.uint64)
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long; keep: more columns (longs) to carry along."""
    keep = keep or {}
    names = [id_col, "fp", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), width, seed) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=names)

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("fp", *keep))])
    return df.select(id_col, text_col, *[c.alias(k) for k, c in keep.items()]).mapInArrow(tidied(run), schema)


def _popcounts(x: np.ndarray, parts: int = 4) -> np.ndarray:
    """Population counts of the equal parts of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(x).view(f"u{8 // parts}").reshape(-1, parts)).astype(np.int16)


def _tiles(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Small tiles of similar population counts, with the least and largest counts of each."""
    counts = _popcounts(x)
    order = np.lexsort(counts.T)
    x, counts = x[order], counts[order]
    for at in range(0, len(x), SMALL):
        c = counts[at : at + SMALL]
        yield x[at : at + SMALL], c.min(0), c.max(0)


def compare(home: np.ndarray, other: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (from home, from other) within the radius, small tile by small tile."""
    right = list(_tiles(other))
    if not right or not len(home):
        return
    lows, highs = np.array([t[1] for t in right]), np.array([t[2] for t in right])
    for x, low, high in _tiles(home):
        gap = np.maximum(np.maximum(lows - high, low - highs), 0).sum(1)
        for j in np.flatnonzero(gap <= radius):
            y = right[j][0]
            a, b = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if len(a):
                yield x[a], y[b]


class Forest:
    """Components of one task's fingerprints: of all its links only a spanning star is sent on."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = np.unique(nodes)
        self.root = np.arange(len(self.nodes))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        apart = self.root[a] != self.root[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.root[max(i, j)] = min(i, j)
        if apart.any():
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        linked = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.nodes[self.root[linked]], self.nodes[linked]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all those within radius bits.

    Each task compares all its pairs; of the links that it finds it returns a star for each of
    its components, so that a large group of near copies gives rows in proportion to its size.
    """
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    steps = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i > 0 or j >= 0)]
    reach = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    # a row visits the tiles "above" its own, so that two tiles meet in one of them only
    visits = (
        distinct.select("fp", high.alias("h"), low.alias("l"), F.explode(reach).alias("s"))
        .select("fp", (F.col("h") + F.col("s.i")).alias("h"), (F.col("l") + F.col("s.j")).alias("l"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
        .where("h <= 32 and l between 0 and 32")
        .select("fp", (F.col("h") * 33 + F.col("l")).alias("tile"), "own")
    )
    part = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(TILE_ROWS))).cast("int")
    # 33 x 33 tiles at most: the table of their sizes has a fixed bound
    sizes = visits.groupBy("tile").agg(part(F.count_if("own")).alias("rows"), part(F.count_if(~F.col("own"))).alias("cols"), F.bool_or("own").alias("used")).where("used")
    placed = visits.join(F.broadcast(sizes), "tile")
    salt = F.xxhash64("fp", F.lit(7))
    # a large tile is cut to a grid: a home row goes to one row of it, a visitor to one column;
    # column -1 - k holds the home rows of grid row k as visitors of the others
    home = placed.where("own").withColumn("row", F.pmod(salt, "rows").cast("int"))
    as_home = home.select("tile", "row", F.explode(F.sequence(-F.col("rows"), F.col("cols") - 1)).alias("col"), "fp", F.lit(True).alias("home"))
    as_other = home.where("rows > 1").select("tile", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), (-1 - F.col("row")).alias("col"), "fp", F.lit(False).alias("home"), F.col("row").alias("from")).where("row < from").drop("from")
    visitor = placed.where("not own").select("tile", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(salt, "cols").cast("int").alias("col"), "fp", F.lit(False).alias("home"))

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        col, row = table.column("col")[0].as_py(), table.column("row")[0].as_py()
        mine, others = fp[home], fp[~home]
        forest = Forest(fp)
        for a, b in compare(mine, mine if col == -1 - row else others, radius):
            forest.add(a, b)
        a, b = forest.star()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    n = tasks_for(distinct.sparkSession)
    # ranges of about equal numbers of rows: large cells get a task of their own, small ones share one
    cells = as_home.union(as_other).union(visitor).repartitionByRange(n, "tile", "row", "col")
    return cells.groupBy("tile", "row", "col").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): each linked node's component, named by its smallest node.

    Rounds of taking the smallest root among the neighbours and jumping to the root's root, until
    nothing changes; a round's table is written to the shared folder. Tasks have joined most
    links already, so there are few rounds.
    """
    pairs = written(edges.union(edges.select("b", "a")).distinct(), folder, "pairs")
    roots = written(pairs.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), folder, "roots0")
    turn = 0
    while True:
        turn += 1
        near = written(pairs.join(roots, pairs["a"] == roots["node"]).groupBy("b").agg(F.min("root").alias("near")), folder, f"near{turn}")
        lower = written(roots.join(near, roots["node"] == near["b"], "left").select("node", "root", F.least("root", "near").alias("lower")), folder, f"lower{turn}")
        up = lower.select(F.col("node").alias("up"), F.col("lower").alias("top"))
        roots = written(lower.join(up, lower["lower"] == up["up"], "left").select("node", F.least("lower", F.coalesce("top", "lower")).alias("root"), "lower", F.col("root").alias("before")), folder, f"roots{turn}")
        if roots.where("root <> before").isEmpty():
            return roots.select("node", "root")
        roots = roots.select("node", "root")


def near_duplicates(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp, component, root): component is the smallest id reachable by links, the own id included;
    root is the fingerprint that stands for the component. keep: more columns (longs) to carry along.
    """
    folder = shared_dir(df.sparkSession)
    prints = written(fingerprints(df, id_col, text_col, width, seed, keep), folder, "prints")
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("first")), folder, "distinct")
    found = written(links(distinct, radius), folder, "links")
    roots = components(found, folder)
    named = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), folder, "named")
    least = written(named.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("root").alias("r"), "component"), folder, "least")
    chosen = written(named.join(least, named["root"] == least["r"], "left").select("fp", F.coalesce("component", "first").alias("component"), "root"), folder, "chosen")
    return joined(prints, chosen, "fp", folder, "prints").select(id_col, "fp", "component", "root", *(keep or ()))


def keep_first(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: that with the smallest id (null last), then by its text.

    Rows are told apart by their id and text, so an id that repeats with other texts is no matter;
    of rows that repeat both, one stays.
    """
    key = {"__k1": F.xxhash64(id_col, text_col), "__k2": F.xxhash64(F.lit(1), text_col, id_col)}
    found = near_duplicates(df, radius, id_col, text_col, keep=key)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "__k1", "__k2"))
    kept = found.groupBy("root").agg(first.alias("f")).select("f.__k1", "f.__k2")
    one = Window.partitionBy("__k1", "__k2").orderBy(F.lit(1))
    rows = df.withColumns(key).withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return rows.join(kept, ["__k1", "__k2"], "left_semi").select(*df.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
