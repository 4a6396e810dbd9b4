"""A trie of conversation prefixes, built level by level.

A conversation is a sequence of turns (role, text); conversations that begin alike share nodes. A
turn is known by a digest of its role and text, so texts are read once and only narrow rows move.
Per depth, the live conversations meet their next turn and are grouped by (parent node, turn); the
smallest member names the group's node. A group whose members go on alike to their ends (one
member, or copies) branches no more: it is a chain, whose nodes are its smallest member's turns, and
its members are live no longer. So a level's rows shrink fast, and there are as many levels of jobs as
the deepest node at which many conversations part, not as the longest has turns. Whether
members go on alike shows in two 64-bit sums (exclusive or) of their remaining turns' hashes with
positions; these need no order and are merged by the aggregate. A group of few members and turns is
given whole to a task, which goes on in the same way, level by level and back.

Afterwards levels are joined upwards, the deepest first: leaves and savings of the children are
summed by their parent.

Each level's tables are written to the shared folder. Turns get their positions from a range sort
with counts of the ranges before; a group of many copies is an aggregate with partial sums and a
join that Spark can split. The members that end at a node are joined to runs of ids below
RUN_IDS apart, and a stream over the sorted runs digests them: no group is held whole.

Cases: turns are ordered by number, null first, then by their digest; null role or text count as
empty; rows without a conversation's id take no part; repeated rows are turns each; an empty table
gives no node; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.common import shared_dir, tasks_for, written
from panelflow.llm.mixing import n_words

#: Ids of members are joined to one text where they agree in id // RUN_IDS.
RUN_IDS = 4096
#: Conversations and turns at most of a group that a task finishes by itself.
SUBTREE_CONVS, SUBTREE_TURNS = 256, 20_000
# kinds of groups: members alike to their ends, few members, and all others
ALIKE, SMALL, LARGE = "alike", "small", "large"
NODES = "node long, depth long, parent long, n long, children long, leaves long, saved long, head boolean"


def turns(df: DataFrame, folder: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, key, words): each conversation's turns, numbered from 1; key is the digest of role and text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), n_words(text).alias("words"))
    order = [F.col("turn").asc_nulls_first(), "key"]
    placed = rows.repartitionByRange(tasks_for(df.sparkSession), "conv", *order).withColumn("part", F.spark_partition_id())
    placed = written(placed, folder, "placed")
    # only conversations that lie in several ranges have turns in ranges before: two a range at most
    counts = placed.groupBy("conv", "part").count()
    split = counts.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("conv"))).where("parts > 1")
    before = F.sum("count").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = split.select("conv", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))
    numbered = placed.withColumn("own", own).join(F.broadcast(offsets), ["conv", "part"], "left")
    return written(numbered.select("conv", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "key", "words"), folder, "turns")


def grafted(rows: DataFrame, taken: Column, stem: Column, most: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first `taken` turns of conversation `stem`, then the own ones behind the first `taken`.

    rows: (conv, pos, key, words). taken, stem: expressions of conv; taken is `most` at most. Gives
    the rebuilt turns and the ids of all conversations, turnless ones too.
    """
    ids = rows.where("pos = 1").select("conv", taken.cast("long").alias("taken"), stem.alias("stem"))
    heads = rows.where(F.col("pos") <= most).groupBy(F.col("conv").alias("stem")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    plan = ids.join(heads, "stem", "left").withColumn("head", F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("taken").cast("int")))
    plan = written(plan.select("conv", "taken", "head", F.size("head").cast("long").alias("got")), folder, "plan")
    front = plan.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.key", "t.words")
    back = rows.join(plan.select("conv", "taken", "got"), "conv").where("pos > taken").select("conv", (F.col("pos") - F.col("taken") + F.col("got")).alias("pos"), "key", "words")
    return written(front.union(back), folder, "rebuilt"), plan.select("conv")


def _sign(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "key")


def trie(rows: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    rows: (conv, pos, key, words) with positions from 1 on; ids: conversations, of which some may have no turn.
    """
    total = rows.groupBy("conv").agg(F.max("pos").alias("len"), F.bit_xor(_sign(1)).alias("s1"), F.bit_xor(_sign(2)).alias("s2"))
    whole = ids.join(total, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("len", "s1", "s2")])
    moved = written(whole, folder, "moved0")
    # level 0 is one group, the root's: one row
    groups = moved.agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("turns")).where("n > 0")
    kind = F.when((F.col("n") <= SUBTREE_CONVS) & (F.col("turns") <= SUBTREE_TURNS), SMALL).otherwise(LARGE)
    groups = written(groups.select(F.lit(None).cast("long").alias("node"), "child", "n", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("last"), kind.alias("kind")), folder, "groups0")
    root = groups.select("child", "kind").first()
    moved = moved.select("conv", F.lit(root[0] if root else None).cast("long").alias("node"), "len", "s1", "s2", F.lit(root[1] if root else SMALL).alias("kind"))
    levels, rest, depth = [(groups, moved)], rows, 0
    while not (live := moved.where((F.col("kind") == LARGE) & (F.col("len") > depth)).drop("kind")).isEmpty():
        if depth:
            rest = written(rest.where(F.col("pos") > depth).join(live.select("conv"), "conv", "left_semi"), folder, f"rest{depth}")
        depth += 1
        step = rest.where(F.col("pos") == depth).join(live, "conv")
        step = written(step.select("conv", "node", "key", "words", "len", F.col("s1").bitwiseXOR(_sign(1)).alias("s1"), F.col("s2").bitwiseXOR(_sign(2)).alias("s2")), folder, f"step{depth}")
        alike = F.lit(True)
        for c in ("len", "s1", "s2"):
            alike = alike & (F.min(c) == F.max(c))
        found = step.groupBy("node", "key").agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.max("len").alias("last"), F.sum("len").alias("turns"), alike.alias("alike"))
        found = written(found.withColumn("kind", F.when(F.col("alike"), ALIKE).otherwise(kind)), folder, f"groups{depth}")
        moved = step.join(found.select("node", "key", "child", "kind"), ["node", "key"])
        moved = written(moved.select("conv", F.col("child").alias("node"), "len", "s1", "s2", "kind"), folder, f"moved{depth}")
        levels.append((found.select("node", "child", "n", "words", "last", "kind"), moved))
    return _rolled_up(rows, levels, folder)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _chains(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes of groups whose members are alike to their ends: NODES without digests."""
    links = rows.join(groups.withColumnRenamed("child", "conv"), "conv").where("pos >= depth").withColumn("worth", (F.col("n") - 1) * F.col("words"))
    # only chains of several members save anything, and only their sums need the turns in order
    below = F.sum("worth").over(Window.partitionBy("conv").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    columns = ["conv", "node", "pos", "depth", "last", "n"]
    links = links.where("n > 1").select(*columns, below.alias("saved")).union(links.where("n = 1").select(*columns, F.lit(0).cast("long").alias("saved")))
    parent = F.when(F.col("pos") == F.col("depth"), F.col("node")).otherwise(F.col("conv"))
    children = F.when(F.col("pos") < F.col("last"), 1).otherwise(0).cast("long")
    return links.select(F.col("conv").alias("node"), F.col("pos").alias("depth"), parent.alias("parent"), "n", children.alias("children"), F.lit(1).cast("long").alias("leaves"), "saved", (F.col("pos") == F.col("depth")).alias("head"))


def _subtree(table: pa.Table) -> pa.Table:
    """The nodes of one small group and all below it, level by level and back."""
    top = table.slice(0, 1).to_pylist()[0]
    convs = [(r["conv"], [(t["key"], t["words"]) for t in r["ahead"]]) for r in table.select(["conv", "ahead"]).to_pylist()]
    # (node, parent's place in the level above, members, words of the last turn)
    level = [(top["node"], None, convs, top["words"])]
    levels, k = [], 0
    while level:
        levels.append(level)
        found: dict[tuple, list] = {}
        for at, (_, _, members, _) in enumerate(level):
            for c in members:
                if len(c[1]) > k:
                    found.setdefault((at, c[1][k][0]), []).append(c)
        level = [(min(c for c, _ in m), at, m, m[0][1][k][1]) for (at, _), m in found.items()]
        k += 1
    out, sums = [], {}
    for k in reversed(range(len(levels))):
        own: dict[int | None, list[int]] = {}
        for at, (node, up, members, words) in enumerate(levels[k]):
            children, leaves, saved = sums.get(at, (0, 0, 0))
            leaves, saved = max(leaves, 1), saved + (len(members) - 1) * words
            ends = ",".join(str(c) for c in sorted(c for c, ahead in members if len(ahead) == k))
            parent = top["parent"] if k == 0 else levels[k - 1][up][0]
            out.append((node, top["depth"] + k, parent, len(members), children, leaves, saved, k == 0, hashlib.sha256(ends.encode()).hexdigest()))
            total = own.setdefault(up, [0, 0, 0])
            for i, x in enumerate((1, leaves, saved)):
                total[i] += x
        sums = own
    names = ["node", "depth", "parent", "n", "children", "leaves", "saved", "head", "sha"]
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.string()]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)


def _rolled_up(rows: DataFrame, levels: list[tuple[DataFrame, DataFrame]], folder: str) -> DataFrame:
    """All nodes; totals are summed from the deepest level to the root."""
    at = [F.lit(depth).cast("long").alias("depth") for depth in range(len(levels))]
    alike = _union([g.where(F.col("kind") == ALIKE).select("child", "node", "n", "last", at[d]) for d, (g, _) in enumerate(levels)])
    chains = written(_chains(rows, alike), folder, "chains")

    heads = _union([g.where(F.col("kind") == SMALL).select(F.col("child").alias("node"), F.col("node").alias("parent"), "words", at[d]) for d, (g, _) in enumerate(levels)])
    members = _union([m.where(F.col("kind") == SMALL).select("conv", "node", at[d]) for d, (_, m) in enumerate(levels)])
    turn = F.struct("pos", "key", F.col("turn_words").alias("words"))
    ahead = members.join(rows.withColumnRenamed("words", "turn_words"), "conv", "left")
    ahead = ahead.groupBy("conv", "node", "depth").agg(F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("depth"), turn))).alias("ahead"))
    small = ahead.join(heads, ["node", "depth"]).groupBy("node", "depth").applyInArrow(_subtree, NODES + ", sha string")
    small = written(small, folder, "subtrees")

    tops = chains.where("head").drop("head").union(small.where("head").drop("head", "sha"))
    lower, branches = None, []
    for depth in reversed(range(len(levels))):
        kids = tops.where(F.col("depth") == depth + 1).select("parent", "leaves", "saved")
        if lower is not None:
            kids = kids.union(lower.select("parent", "leaves", "saved"))
        sums = kids.groupBy(F.col("parent").alias("child")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
        level = levels[depth][0].where(F.col("kind") == LARGE).join(sums, "child", "left")
        saved = (F.col("n") - 1) * F.col("words") + F.coalesce("below", F.lit(0))
        lower = level.select(F.col("child").alias("node"), at[depth], F.col("node").alias("parent"), "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), saved.alias("saved"))
        lower = written(lower, folder, f"level{depth}")
        branches.append(lower)
    last = lambda d: (F.col("kind") == ALIKE) | ((F.col("kind") == LARGE) & (F.col("len") == d))
    ends = _union([m.where(last(d)).select(F.col("len").alias("depth"), "node", "conv") for d, (_, m) in enumerate(levels)])
    found = _union([chains.drop("head"), *branches]).join(_digests(ends), ["depth", "node"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = found.select("node", "depth", "parent", "n", "children", "leaves", "saved", F.coalesce("sha", none).alias("sha")).union(small.drop("head"))
    return found.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, node, sha) of the ids of the conversations that end at each node."""
    run = ends.groupBy("depth", "node", F.floor(F.col("conv") / RUN_IDS).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    sorted_runs = run.repartition(tasks_for(ends.sparkSession), "depth", "node").sortWithinPartitions("depth", "node", "run")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) == held:
                    sha.update(b"," + ids.encode())
                    continue
                if held is not None:
                    done.append((*held, sha.hexdigest()))
                held, sha = (depth, node), hashlib.sha256(ids.encode())
            if done:
                yield _batch(done)
        if held is not None:
            yield _batch([(*held, sha.hexdigest())])

    return sorted_runs.mapInArrow(digest, "depth long, node long, sha string")


def _batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, node, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"depth": pa.array(depth, pa.int64()), "node": pa.array(node, pa.int64()), "sha": sha})


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """trie() of the conversations as they are."""
    folder = shared_dir(df.sparkSession)
    rows = turns(df, folder, id_col, turn_col, role_col, text_col)
    return trie(rows, rows.where("pos = 1").select("conv"), folder)


def grafted_trie(df: DataFrame, stems: int = 20, most: int = 3) -> DataFrame:
    """trie() of the conversations, each behind the first turns of the one at the multiple of `stems` before it.

    How many: the crc32 of its decimal id modulo most + 1.
    """
    folder = shared_dir(df.sparkSession)
    conv = F.col("conv")
    taken = F.crc32(conv.cast("string").cast("binary")) % (most + 1)
    return trie(*grafted(turns(df, folder), taken, conv - conv % stems, most, folder), folder)
