"""Near duplicates as an exact Jaccard join of 5-word shingle sets in metric space.

Jaccard distance is a metric, but almost all pairs of documents are at distance 1 of each other, where pivots cannot tell
them apart.  So the join starts from cells of documents that share a shingle, and splits each further by pivots:

- A cell's pivots are members with the lowest priorities, more of them the larger the cell.  Every member's exact distance
  to them is computed, and members within the limit are linked to the pivot.
- The nearest pivot makes the Voronoi cell that is a member's home.  If two documents are linked, the distances of either
  to the two home pivots differ by no more than twice the limit; so a member is also a guest of every cell, of a pivot
  before its own, whose pivot is no farther than that beyond its nearest one, and no farther from the pivot than the cell's
  radius and the limit.  Homes are joined with homes and guests; guests among themselves are not.
- What is linked already needs no comparison: a guest of the same component as all homes leaves, and a cell with one
  component is done.  Cells of few members are joined directly, where the distances to their pivot differ by no more than
  the limit; larger ones are split again.
- Pivots don't tell the members of a dense group apart, such as the copies of one text with edits of their own: all of them
  are within the window of all its pivots.  A cell that would not become smaller stays one, and is joined directly once
  its largest component has met what is outside it.  Those outside then look for partners by size, of which the place of
  the shared element leaves few, so that no two members of the largest component are set against each other.

Documents that have no partner by counting leave first.  Of two sets with 100 * intersection >= 75 * union, each finds
at least T of the other's elements among its first by hash (``prefix``), so a set of whose prefix fewer than T elements
occur elsewhere has none.  Those left are listed by the rarest elements (``first_of``), of which two linked sets share
one: a passage that many documents share makes no cell of documents of which it is a small part.

Equal sets are one class from the start, named by a 128-bit digest of the set, rows by a 128-bit digest of doc_id and text.
Shingles have 64-bit hashes: two that share one count as equal.

Nulls and odd cases: a document without text or words has an empty set and is linked with nothing, its component is its
own doc_id; a null doc_id takes part, and counts for a component's smallest doc_id only if there is no other; repeated
rows are in one class; texts are read whole; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import bloom_filters, forget, keeps_columns, small_batches, table, written
from locusframe.llm.words import shingle_hashes

WIDTH = 5
#: Links need PERCENT of 100 of the union in common.
PERCENT = 75
LIMIT = 1 - PERCENT / 100
#: Added to windows over distances, which are doubles; links are decided on integers.
SLACK = 1e-9
#: Pivots of a cell at most; members for each of them; members of a cell that is joined directly, and of one that was
#: touched before.
PIVOTS, MEMBERS, DIRECT, TOUCHED = 16, 16, 32, 2048


def least_common(n: int | np.ndarray | Column):
    """Common elements that a set of n has with a partner, at least: ceil(0.75 n)."""
    return (n * PERCENT + 99) // 100 if not isinstance(n, Column) else F.floor((n * PERCENT + 99) / 100)


def asked(n):
    """T: elements of the prefix that a partner shares."""
    return max(1, n // 8) if not isinstance(n, Column) else F.greatest(F.lit(1), F.floor(n / 8))


def prefix(n: int) -> int:
    """Length of the prefix.  Two more than T alone needs make up for the rounding when sizes differ."""
    return min(n, n - least_common(n) + asked(n) + 2)


def first_of(n: Column) -> Column:
    """How many of its elements, in any order that all sets share, hold one of a partner's."""
    return n - least_common(n) + 1


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def row_name() -> Column:
    """Digest of doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def outline(docs: DataFrame) -> DataFrame:
    """docs: (row, doc_id, text).  row, doc_id, set_id and n_shingles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = shingle_hashes(_encoded(batch.column(2)), WIDTH)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([set_name(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["row", "doc_id", "set_id", "n_shingles"])

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "row binary, doc_id long, set_id binary, n_shingles long")


def elements(docs: DataFrame, whole_sets: bool = False) -> DataFrame:
    """docs: (text).  (element, set_id) of the prefixes, or of the whole sets.  A task sends a set once however many of
    its documents have it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                parts, names = [], []
                for s in shingle_hashes(_encoded(whole.slice(at, 500).column(0)), WIDTH):
                    if len(s) and (name := set_name(s)) not in seen:
                        seen.add(name)
                        parts.append(s if whole_sets else s[: prefix(len(s))])  # in the order of the hash
                        names.append(name)
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(names, object), [len(p) for p in parts]), pa.binary())], ["element", "set_id"])

    return docs.select("text").mapInArrow(read, "element long, set_id binary")


def with_partners(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, n_shingles, row) of the sets of whose prefix at least T elements occur in other sets."""
    of = Window.partitionBy("element")
    rows = elements(docs).withColumns({"low": F.min("set_id").over(of), "high": F.max("set_id").over(of), "before": F.lag("set_id").over(of.orderBy("set_id"))})
    # several tasks may have sent a set; only what is shared goes on to the next shuffle
    rows = rows.filter((F.col("low") != F.col("high")) & (F.col("before").isNull() | (F.col("before") != F.col("set_id"))))
    held = rows.groupBy("set_id").agg(F.count("*").alias("held"))
    return sets.join(held, "set_id").filter(F.col("held") >= asked(F.col("n_shingles"))).select("set_id", "n_shingles", "row")


def regions(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """texts: (set_id, text), sets: (set_id, n_shingles).  (element, set_id, n_shingles, place): the sets that hold an
    element among the first by rarity, and at which place."""
    of, own = Window.partitionBy("element"), Window.partitionBy("set_id")
    rows = elements(texts, whole_sets=True).withColumn("uses", F.count("*").over(of)).filter("uses > 1")
    rows = rows.withColumns({"held": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("uses", "element"))})
    rows = rows.join(sets.select("set_id", "n_shingles"), "set_id").withColumn("place", F.col("n_shingles") - F.col("held") + F.col("rank"))
    rows = rows.filter(F.col("place") <= first_of(F.col("n_shingles")))
    # a partner's size at most, if this is the first common element; of two partners, the smaller one's is no less than its own
    most = F.floor((1 + F.col("n_shingles") - F.col("place")) * (100 + PERCENT) / PERCENT) - F.col("n_shingles")
    rows = rows.withColumn("most", most).withColumn("least", F.min(F.when(F.col("most") >= F.col("n_shingles"), F.col("n_shingles"))).over(of)).filter(F.col("most") >= F.col("least"))
    rows = rows.withColumns({"low": F.min("set_id").over(of), "high": F.max("set_id").over(of)})
    return rows.filter("low <> high").select("element", "set_id", "n_shingles", "place")


def distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: (low, high); texts: (set_id, text).  Adds linked and the distance d of the exact sets."""
    both = pairs.join(texts.select(F.col("set_id").alias("high"), "text"), "high").join(texts.select(F.col("set_id").alias("low"), F.col("text").alias("low_text")), "low")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, linked, d = whole.slice(at, 500), [], []
                names = batch.column(0).dictionary_encode()
                first = np.unique(names.indices.to_numpy(), return_index=True)[1]
                mine = shingle_hashes(_encoded(batch.column(3).take(pa.array(first))), WIDTH)
                for k, s in zip(names.indices.to_pylist(), shingle_hashes(_encoded(batch.column(2)), WIDTH)):
                    common = len(np.intersect1d(s, mine[k], assume_unique=True))
                    union = len(s) + len(mine[k]) - common
                    linked.append(common * 100 >= union * PERCENT)
                    d.append(1 - common / union)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(d, pa.float64())], ["low", "high", "linked", "d"])

    return both.select("low", "high", "text", "low_text").mapInArrow(read, "low binary, high binary, linked boolean, d double")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: (a, b).  (node, label, old): the smallest reachable, for every node of an edge.

    First each node keeps the edge to its least neighbour, to which its other lesser neighbours are tied instead, so that
    many edges into one group become about as many as it has nodes.  Then each round takes the least label of a node's
    neighbours and the label's own label; joins are of written tables, so that a node with very many edges can be split.
    """
    pairs = written(edges.select(*_pair("a", "b")).filter("low <> high").distinct(), "pairs")
    tied = pairs.join(pairs.groupBy("high").agg(F.min("low").alias("least")), "high")
    few = tied.select(F.col("high").alias("x"), F.col("least").alias("y")).union(tied.filter("low <> least").select("low", "least")).distinct()
    both = written(few.union(few.select("y", "x")).distinct(), "edges")
    forget(pairs)
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label"), F.lit(None).cast("binary").alias("old")), "labels")
    for _ in range(rounds):
        jumped = labels.select("node", "label").join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        jumped = written(jumped.select("node", F.least("label", F.coalesce("next", "label")).alias("label"), F.col("label").alias("old")), "jumped")
        near = both.join(jumped.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        new = written(jumped.join(near, "node").select("node", F.least("label", "near").alias("label"), "old"), "labels")
        forget(labels, jumped)
        if new.filter("label <> old").isEmpty():
            forget(both)
            return new
        labels = new
    raise ValueError(f"components did not settle in {rounds} rounds")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def _fit(other_n: str, other_place: str) -> Column:
    """Whether sizes and places allow a link, if the cell's element is the first common one."""
    n, sizes = F.col("n_shingles"), F.least("n_shingles", other_n) * 100 >= F.greatest("n_shingles", other_n) * PERCENT
    rest = 1 + F.least(n - F.col("place"), F.col(other_n) - F.col(other_place))
    return sizes & (rest * (100 + PERCENT) >= PERCENT * (n + F.col(other_n)))


def _chosen(cells: DataFrame, level: int, *before: Column) -> DataFrame:
    """(cell, part, pivot, ...): of each part of a cell, the member of the lowest priority, after what comes before it.  It
    depends on the set alone, so that the cells of one group share pivots."""
    part = F.pmod(F.xxhash64("set_id"), F.col("n_pivots")).alias("part")
    chosen = cells.groupBy("cell", part).agg(F.min(F.struct(*before, F.xxhash64("set_id", F.lit(level)).alias("p"), "set_id", "n_shingles", "place", "label", "home")).alias("f"))
    return chosen.select("cell", "part", F.col("f.set_id").alias("pivot"), F.col("f.n_shingles").alias("pivot_n"), F.col("f.place").alias("pivot_place"), F.col("f.label").alias("pivot_label"), F.col("f.home").alias("pivot_home"))


def _split(active: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The cells to be split: (pivots, met), where met has each member with each pivot, and whether their distance is
    asked for; in a cell with one pivot, only where a link is possible.  Pivots are outside the cell's
    largest component, as the members of that one need not meet each other."""
    pivots = written(_chosen(active.filter(F.col("label") != F.col("main")), level), "pivots")
    needed = (F.col("n_pivots") > 1) | ((F.col("label") != F.col("pivot_label")) & _fit("pivot_n", "pivot_place"))
    met = active.join(pivots, "cell").filter(F.col("set_id") != F.col("pivot"))
    return pivots, written(met.select("cell", "part", "set_id", "n_shingles", "place", "home", "pivot", needed.alias("needed")), "met")


def _touched(active: DataFrame, level: int) -> DataFrame:
    """(low, high): some of a cell's largest component with each member outside it, which links most of those that have a link.
    The first by place have the fewest elements of their own, so they are near most others, and most sizes fit theirs."""
    pivots = _chosen(active.filter(F.col("label") == F.col("main")), level, F.col("place").alias("first"))
    outside = active.filter((F.col("label") != F.col("main"))).join(pivots, "cell").filter((F.col("home") | F.col("pivot_home")) & _fit("pivot_n", "pivot_place"))
    return outside.select(*_pair("set_id", "pivot"))


def _joined(few: DataFrame) -> DataFrame:
    """(low, high) of the cells to be joined directly: pairs of different components with a home in them that neither
    sizes, nor the distances to the cell's pivot, nor the places of the shared element rule out."""
    other = few.select("cell", *[F.col(c).alias(f"{c}_") for c in ("set_id", "n_shingles", "place", "home", "label", "away")])
    once = F.col("home") & (~F.col("home_") | (F.col("set_id") < F.col("set_id_")))
    on = (F.col("label") != F.col("label_")) & once & _near() & _fit("n_shingles_", "place_")
    return few.join(other, "cell").filter(on).select(*_pair("set_id", "set_id_"))


def _near() -> Column:
    return F.coalesce(F.abs(F.col("away") - F.col("away_")) <= LIMIT + SLACK, F.lit(True))


def _asked_by_size(some: DataFrame) -> DataFrame:
    """The same pairs as ``_joined``, for cells of any size: members outside the largest component, with the members of
    those sizes in the cell that ``_fit`` allows them."""
    rest = (1 + F.col("n_shingles") - F.col("place")) * (100 + PERCENT)
    allowed = (F.col("n_shingles_") + F.col("n_shingles")) * PERCENT <= rest
    asking = some.filter(F.col("label") != F.col("main")).select("cell", "set_id", "n_shingles", "place", "home", "label", "main", "away")
    asking = asking.join(some.select("cell", F.col("n_shingles").alias("n_shingles_")).distinct(), "cell").filter(allowed)
    other = some.select("cell", *[F.col(c).alias(f"{c}_") for c in ("set_id", "n_shingles", "place", "home", "label", "away")])
    once = (F.col("home") | F.col("home_")) & ((F.col("label_") == F.col("main")) | (F.col("set_id") < F.col("set_id_")))
    on = (F.col("label") != F.col("label_")) & once & _near() & _fit("n_shingles_", "place_")
    return asking.join(other, ["cell", "n_shingles_"]).filter(on).select(*_pair("set_id", "set_id_"))


def _cells(met: DataFrame, pivots: DataFrame, known: DataFrame) -> DataFrame:
    """The members of the next cells: homes of the nearest pivot, guests of those within the window.  A cell of which one
    would hold more than half, or all together more than twice its members, stays as it is and is not apart."""
    far = met.withColumns(dict(zip(("low", "high"), _pair("set_id", "pivot")))).join(known.select("low", "high", "d"), ["low", "high"], "left")
    far = far.join(pivots.select("cell", F.col("pivot").alias("set_id")), ["cell", "set_id"], "left_anti")  # they have met all members
    each = far.groupBy("cell", "set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("place").alias("place"), F.first("home").alias("home"), F.collect_list(F.struct("d", "part")).alias("all"))  # at most PIVOTS
    to, nearest = F.col("to"), F.array_min("all")
    own = F.col("home") & (to["part"] == nearest["part"])
    guest = (~F.col("home") | (to["part"] < nearest["part"])) & F.coalesce(to["d"] <= nearest["d"] + 2 * LIMIT + SLACK, F.lit(True))
    each = written(each, "to-pivots")
    path = F.concat("cell", F.unhex(F.lpad(F.hex(to["part"]), 2, "0")))
    parts = each.select("*", F.explode("all").alias("to")).select("cell", "set_id", "n_shingles", "place", "home", "all", "to", own.alias("own")).filter(F.col("own") | guest)
    sizes = parts.groupBy("cell", "to.part").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("in_all"), F.max("n").alias("largest"))
    sizes = sizes.join(each.groupBy("cell").agg(F.count("*").alias("size")), "cell")
    sizes = written(sizes.select("cell", ((F.col("in_all") <= 2 * F.col("size")) & (F.col("largest") <= F.col("size") / 2)).alias("apart")), "sizes")
    split = parts.join(sizes.filter("apart"), "cell").select(path.alias("cell"), "set_id", "n_shingles", "place", F.col("own").alias("home"), to["d"].alias("away"), "apart")
    first = F.array_min(F.transform("all", lambda x: F.struct(x["part"], x["d"])))  # all of a cell have met its first pivot
    kept = each.join(sizes.filter("not apart"), "cell").select("cell", "set_id", "n_shingles", "place", "home", first["d"].alias("away"), "apart")
    out = written(split.unionByName(kept), "cells")
    forget(each, sizes)
    return out


def linked_sets(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members: (element, set_id, n_shingles, place), the regions.  (set_id, label) for every set with a link: equal labels
    are connected.

    Cells are split at even levels.  At odd ones small cells are joined directly, and each of the others is touched: some
    of its largest component meet those outside it.  Then all but the largest cells are joined, and these are split again,
    unless a split has left them as they were.
    """
    spark = members.sparkSession
    cells = members.select(F.unhex(F.lpad(F.hex("element"), 16, "0")).alias("cell"), "set_id", "n_shingles", "place", F.lit(True).alias("home"), F.lit(None).cast("double").alias("away"), F.lit(True).alias("apart"))
    labels, level = spark.createDataFrame([], "node binary, label binary"), 0
    known = spark.createDataFrame([], "low binary, high binary, linked boolean, d double")
    while True:
        named = cells.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        by = named.groupBy("cell", "label").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"), F.max(F.when(F.col("home"), F.coalesce("away", F.lit(1.0)))).alias("radius"), F.first("apart").alias("apart"))
        by = by.groupBy("cell").agg(
            F.sum("all").alias("size"), F.count_if(F.col("homes") > 0).alias("kinds"), F.count("*").alias("all_kinds"), F.max(F.struct("all", "label")).alias("m"), F.max(F.struct("homes", "label"))["label"].alias("own"), F.max("radius").alias("radius"), F.first("apart").alias("apart")
        )
        direct = F.col("size") <= (0 if level == 0 else DIRECT if level == 1 else TOUCHED)
        if level % 2 == 0:
            direct |= ~F.col("apart")
        by = by.filter("kinds > 0 and all_kinds > 1").select("cell", "kinds", "own", F.col("m.label").alias("main"), "radius", F.least(F.lit(PIVOTS), 1 + F.floor(F.col("size") / MEMBERS)).alias("n_pivots"), direct.alias("direct"))
        useful = F.col("home") | (((F.col("kinds") > 1) | (F.col("label") != F.col("own"))) & F.coalesce(F.col("away") <= F.col("radius") + LIMIT + SLACK, F.lit(True)))
        active = written(named.join(by, "cell").filter(useful), "cells")
        if active.isEmpty():
            return labels.select(F.col("node").alias("set_id"), "label")
        large, before = active.filter("not direct"), cells
        if level % 2:
            pairs = _touched(large, level)
        else:
            pivots, met = _split(large, level)
            pairs = met.filter("needed").select(*_pair("set_id", "pivot"))
        if level:
            pairs = pairs.union((_joined if level == 1 else _asked_by_size)(active.filter("direct")))
        pairs = pairs.distinct()
        found = written(distances(pairs.join(known, ["low", "high"], "left_anti") if level else pairs, texts), "distances")
        known = known.union(found) if level else found
        new = found.filter("linked").select(F.col("low").alias("a"), F.col("high").alias("b"))
        if not new.isEmpty():
            # what was connected before is so by its labels
            old = labels
            labels = components(new.union(labels.select("node", "label")))
            forget(old)
        if level % 2:
            cells = written(large.select(*before.columns), "cells")
        else:
            cells = _cells(met, pivots, known)
            forget(pivots, met)
        forget(active, before)
        level += 1


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text).  row (a digest of doc_id and text), doc_id, n_shingles, class_id and component_id, a row a document.

    class_id names the class of linked documents (the smallest set_id in it; null without a word).  component_id, its
    smallest doc_id, doesn't: unrelated documents can share a doc_id or have none.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs.select(row_name().alias("row"), "doc_id", "text"))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    listed = written(outline(docs), "outline")
    sets = written(listed.filter("n_shingles > 0").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("smallest"), F.min("row").alias("row")), "sets")
    some = written(with_partners(docs, sets), "with-partners")
    with bloom_filters(docs.sparkSession):
        texts = docs.select("row", "text").join(some.select("row", "set_id").hint("merge"), "row").groupBy("set_id").agg(F.first("text").alias("text"))
        texts = written(texts, "texts")
    members = written(regions(texts, some), "regions")
    linked = linked_sets(members, texts)
    # a set's component: the smallest doc_id of all its sets
    named = written(sets.select("set_id", "smallest").join(linked, "set_id"), "linked")
    forget(some, texts, members)
    least = written(named.groupBy("label").agg(F.min("smallest").alias("component_id")), "least")
    named = named.join(least, "label").select("set_id", "label", "component_id")
    own = written(sets.join(named, "set_id", "left").select("set_id", F.coalesce("label", "set_id").alias("class_id"), F.coalesce("component_id", "smallest").alias("component_id")), "set-components")
    out = listed.join(own, "set_id", "left")
    return out.select("row", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of linked documents, the row with the smallest doc_id stays; among rows that share it, the one with
    the smallest digest.  Documents without a word are in no class and stay."""
    found = near_duplicates(docs.select("doc_id", "text"))
    kept = found.filter("n_shingles > 0").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k"))
    kept = kept.select(F.col("k.row").alias("_row"))
    wordless = found.filter("n_shingles = 0").select(F.col("row").alias("_row"))
    rows = docs.withColumn("_row", row_name())
    order = Window.partitionBy("_row").orderBy(F.lit(1))
    first = rows.join(kept, "_row", "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return first.unionByName(rows.join(wordless.distinct(), "_row", "left_semi")).select(*docs.columns)
