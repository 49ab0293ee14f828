"""The prefix trie of conversations, by prefix doubling.

Two conversations are in one node of depth d if their first d turns (role, text) are equal.  Turns get dense numbers as
names; blocks of 2^k turns, aligned at multiples of 2^k, are named by the names of their halves, in a round for each k.  A
prefix of d turns is its largest block, the next one and so on, as the binary form of d says: with 2^k the lowest bit of d
it is the prefix of d - 2^k turns and one block more, so going from the largest k down every prefix is named once, in as
many rounds again.  The work of all rounds is linear in the turns, however long a conversation is.  A node is a depth and a
name; names are equal only where the turns are (turns by the SHA-256 of role and text).

Sums over subtrees need no walk.  Every node belongs to its smallest member; the nodes of one conversation are then a
stretch of depths down to its end.  So a sum over the nodes below v is, over the members of v, what each has of its own at
depth v and below: for all but the smallest member that is all it has.

A conversation may hold any number of turns, and a node any number of members: turns are numbered, and sums along a
conversation taken, within stretches of ``STRETCH`` behind the sums of the stretches before; hot names are joined to rows
by joins that Spark can split.  The digest of a node's ends is taken over one byte string, in its order, so it is a stream
in one task; before that ids are put together by ``ENDS`` neighbouring ids, so few rows meet.

Nulls and odd cases: rows without conv_id belong to no conversation; a null turn comes first, equal turns go by role, then
text; null roles and texts are empty; repeated rows are turns of their own; a conversation without turns (or all of whose
turns are taken away by rebuilding) is in the root alone; an empty table has no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import forget, table, written

#: Turns of a conversation in a window together, 2 ** STRETCH; ids in a piece of a node's ends, 2 ** ENDS.
STRETCH, ENDS = 10, 12


def running(rows: DataFrame, key: str, stretch: Column, order: list[Column], sums: dict[str, Column], down: bool = False) -> DataFrame:
    """``rows`` with running sums by ``key``, the row's own included, in the order of ``stretch`` (from its end if
    ``down``) and within it of ``order``.  No window holds more than a stretch, or a row a stretch."""
    rows = rows.withColumn("_stretch", stretch)
    within = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumns({f"_sum_{n}": F.sum(c).over(within) for n, c in sums.items()}), "trie-running")
    whole = rows.groupBy(key, "_stretch").agg(*[F.max(f"_sum_{n}").alias(f"_whole_{n}") for n in sums])  # terms are not negative
    by = F.col("_stretch").desc_nulls_last() if down else F.col("_stretch").asc_nulls_first()
    before = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col(key).alias("_key"), F.col("_stretch").alias("_of"), *[F.coalesce(F.sum(f"_whole_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    out = rows.join(whole, (F.col(key) == F.col("_key")) & F.col("_stretch").eqNullSafe(F.col("_of")))
    return out.withColumns({n: (F.col(f"_before_{n}") + F.col(f"_sum_{n}")).cast("long") for n in sums}).drop("_stretch", "_key", "_of", *[f"{p}{n}" for n in sums for p in ("_sum_", "_before_")])


def turns_of(conversations: DataFrame) -> DataFrame:
    """conversations: (conv_id, turn, role, text).  (conv, pos, turn, chars): turns numbered from 0, turn a digest of role
    and text, chars the text's code points."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("at"), empty("role"), empty("text"))
    rows = rows.groupBy("conv", "at", "role", "text").agg(F.count(F.lit(1)).alias("times"))  # repeated rows travel once
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    order = [F.col("at").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = rows.withColumns({"turn": digest, "chars": F.char_length("text").cast("long")})
    within = Window.partitionBy("conv", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("_block", F.shiftright("at", STRETCH)).withColumn("rank", F.row_number().over(within))
    numbered = numbered.select("conv", "at", "rank", "times", "turn", "chars")  # texts are left behind
    numbered = running(numbered, "conv", F.shiftright("at", STRETCH), [F.col("rank")], {"end": F.col("times")})
    return numbered.select("conv", F.explode(F.sequence(F.col("end") - F.col("times"), F.col("end") - 1)).alias("pos"), "turn", "chars")


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a dense number from 0 for each distinct ``keys``, in a table."""
    distinct = written(rows.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()), "trie-names")
    task, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    tasks = distinct.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # a row a task that wrote names
    tasks = tasks.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    dense = distinct.join(F.broadcast(tasks), task == F.col("_task")).select(*keys, (F.col("_before") + place).cast("long").alias(name))
    out = written(rows.join(dense, keys), "trie-rows")
    forget(distinct)
    return out


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns: (conv, pos, turn), convs: (conv) of all conversations.  (conv, depth, node): a row a prefix; conversations with
    equal prefixes have equal (depth, node)."""
    longest = (turns.agg(F.max("pos")).first()[0] + 1) if turns.take(1) else 0
    prefixes = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"))
    if not longest:
        return prefixes
    levels = [_named(turns, ["turn"], "block").select("conv", F.col("pos").alias("j"), "block")]
    while 2 ** len(levels) <= longest:
        halves = levels[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(
            F.max(F.when(F.col("j") % 2 == 0, F.col("block"))).alias("left"), F.max(F.when(F.col("j") % 2 == 1, F.col("block"))).alias("right")
        )
        levels.append(_named(halves.filter("left is not null and right is not null"), ["left", "right"], "block").select("conv", "j", "block"))
    for k in range(len(levels) - 1, -1, -1):
        more = levels[k].filter("j % 2 = 0").select("conv", F.shiftleft("j", k).alias("depth"), "block")
        more = more.join(prefixes, ["conv", "depth"]).select("conv", (F.col("depth") + 2**k).alias("depth"), F.col("node").alias("before"), "block")
        prefixes = prefixes.unionByName(_named(more, ["depth", "before", "block"], "node").select("conv", "depth", "node"))
    return prefixes


def _digests(ends: DataFrame) -> DataFrame:
    """ends: (depth, node, conv).  (depth, node, ends_sha256) over the decimal ids, ascending, with commas between."""
    pieces = ends.groupBy("depth", "node", F.shiftright("conv", ENDS).alias("piece")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))  # ids are distinct
    pieces = pieces.select("depth", "node", "piece", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for depth, name, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, name) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, name), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "ends_sha256"])
            done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "node", "ends_sha256"])

    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece").mapInArrow(digest, "depth long, node long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns: (conv, pos, turn, chars), convs: (conv), all of them.  A row a node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, (members - 1) times the last text's code
    points), ends_sha256 (of the members that end there)."""
    every = written(members(turns, convs), "trie-members")
    nodes = written(every.groupBy("depth", "node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    parents = every.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    own = nodes.join(parents, ["conv", "depth"], "left").join(turns.select("conv", (F.col("pos") + 1).alias("depth"), "chars"), ["conv", "depth"], "left")
    own = own.withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0)))
    children = own.filter("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = own.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = own.withColumn("leaf", (F.col("n_children") == 0).cast("long")).drop("chars")
    own = written(running(own, "conv", F.shiftright("depth", STRETCH), [F.col("depth").desc()], {"saved_below": F.col("saved"), "leaves_below": F.col("leaf")}, down=True), "trie-own")
    totals = own.groupBy("conv").agg(F.sum("saved").alias("saved_all"), F.sum("leaf").alias("leaves_all"))
    others = every.join(totals, "conv").groupBy("depth", "node").agg(F.sum("saved_all").alias("saved_members"), F.sum("leaves_all").alias("leaves_members"))
    lengths = every.groupBy("conv").agg(F.max("depth").alias("depth"))
    ends = _digests(every.join(lengths, ["conv", "depth"]).select("depth", "node", "conv"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = own.join(totals, "conv").join(others, ["depth", "node"]).join(ends, ["depth", "node"], "left").join(above, ["depth", "parent"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_members") - F.col("leaves_all") + F.col("leaves_below")).alias("n_leaves"),
        (F.col("saved_members") - F.col("saved_all") + F.col("saved_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: (conv, pos, turn, chars) as they are.  (turns, convs) with the first h turns of every conversation c taken from
    conversation c - c % 100, as far as that has them, and its own turns after its first h: h = crc32(c) % 6."""
    lengths = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-lengths")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h")
    heads = lengths.select("conv", h, (F.col("conv") - F.col("conv") % 100).alias("base"))
    heads = heads.join(lengths.select(F.col("conv").alias("base"), "n"), "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    first = turns.filter("pos < 5 and conv % 100 = 0").withColumnRenamed("conv", "base")  # of at most 100 conversations each
    first = first.join(heads.select("conv", "base", "h"), "base").filter("pos < h").select("conv", "pos", "turn", "chars")
    rest = turns.join(heads.select("conv", "h", "taken"), "conv").filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "chars")
    return first.unionByName(rest), lengths.select("conv")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(written(turns_of(table(spark, sf_dir, "conversations")), "trie-numbered"))
    return trie(written(turns, "trie-turns"), convs)
