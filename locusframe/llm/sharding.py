"""Sharding by a uniform shuffle with exact shard sizes, in built-in functions only.

A uniformly random order of all rows, cut into shards whose sizes differ by one at most, is drawn without sorting all
rows: how many rows of each input partition go to each shard follows a multivariate hypergeometric law, so that
communication matrix is drawn first.  Then each partition's rows are permuted by themselves and dealt out by its line of
the matrix, exchanged, and permuted again within their shard, which gives the slots.

The matrix is drawn from the top down: the counts of a group of partitions are split over its ``FAN`` parts, these over
theirs, so a task folds over ``FAN`` lines at a time however many partitions there are.  One entry is drawn by inversion
from the mode outwards (``hypergeometric``), over as many terms as its spread needs.  The second permutation ranks rows
within (shard, bucket of their random key) behind the sizes of the buckets before, so that no task gets a whole shard.

All random numbers are hashes of the seed and of a row's place in the input (partition, number within), which is written
down first: a lost task is made again alike.  Another way of splitting the input gives another, equally uniform, shuffle.

Nulls and odd cases: a null text has size 1 and the checksum of the empty text; a null doc_id is kept; repeated rows and
equal texts are rows of their own; fewer rows than shards leave shards empty; an empty table gives an empty result;
further columns are kept by ``shuffled`` under any name but ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import forget, table, written

SHARDS = 16
SEED = 13
#: Lines of the matrix that one task draws in turn: 2 ** FAN_BITS.
FAN_BITS = 6
#: Buckets of a shard's second permutation.
BUCKETS = 1024
#: Terms on either side of the mode: REACH standard deviations and LEAST more.  What lies beyond has a probability under
#: 2 ** -53, the step of the random number that is inverted.
REACH, LEAST = 12, 30


def _bound(values: Column, body) -> Column:
    """body(v) with v a struct that is computed once."""
    return F.transform(F.array(values), body)[0]


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows drawn from ``total`` are among the ``good`` ones, as the inverse at ``u`` (0 <= u < 1) of
    the law's distribution, its values taken in the order mode, above it, below it."""
    d = lambda x: x.cast("double")
    given = F.struct(total.cast("long").alias("total"), good.cast("long").alias("good"), draws.cast("long").alias("draws"), d(u).alias("u"))

    def ranged(g: Column) -> Column:
        low, high = F.greatest(F.lit(0).cast("long"), g["draws"] - (g["total"] - g["good"])), F.least(g["draws"], g["good"])
        mode = F.greatest(low, F.least(high, F.floor((d(g["draws"]) + 1) * (d(g["good"]) + 1) / (d(g["total"]) + 2)).cast("long")))
        share = d(g["good"]) / F.greatest(d(g["total"]), F.lit(1.0))
        spread = F.sqrt(F.greatest(F.lit(0.0), d(g["draws"]) * share * (1 - share) * (d(g["total"]) - d(g["draws"])) / F.greatest(d(g["total"]) - 1, F.lit(1.0))))
        return F.struct(mode.alias("mode"), (mode - low).alias("below"), (high - mode).alias("above"), F.ceil(spread * REACH + LEAST).cast("long").alias("reach"),
                        d(g["good"]).alias("good"), d(g["draws"]).alias("draws"), (d(g["total"]) - d(g["good"]) - d(g["draws"])).alias("rest"), g["u"].alias("u"))

    def drawn(v: Column) -> Column:
        up, down = F.least(v["above"], v["reach"]), F.least(v["below"], v["reach"])
        none = F.array().cast("array<long>")
        one = F.lit(1).cast("long")
        steps = F.concat(F.when(up > 0, F.sequence(one, up)).otherwise(none), F.when(down > 0, F.sequence(-one, -down, -one)).otherwise(none))

        def term(s: Column, i: Column, goal: Column) -> Column:
            k = d(v["mode"] + i)
            before = F.when(F.abs(i) == 1, F.lit(1.0)).otherwise(s["w"])
            w = before * F.when(i > 0, (v["good"] - k + 1) * (v["draws"] - k + 1) / (k * (v["rest"] + k))).otherwise((k + 1) * (v["rest"] + k + 1) / ((v["good"] - k) * (v["draws"] - k)))
            return _bound(w, lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), F.when(s["at"].isNotNull(), s["at"]).when(goal < s["sum"] + w, v["mode"] + i).alias("at")))

        def fold(goal: Column, first: Column) -> Column:
            return F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), first.cast("long").alias("at")), lambda s, i: term(s, i, goal))

        whole = fold(F.lit(float("inf")), F.lit(None))["sum"]
        return _bound(whole * v["u"], lambda goal: F.coalesce(fold(goal, F.when(goal < 1, v["mode"]))["at"], v["mode"]))

    return _bound(given, lambda g: _bound(ranged(g), drawn))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / 2.0**53


def _line(room: Column, rows: Column, shards: int, *of: Column) -> Column:
    """Counts by shard of ``rows`` rows that go to shards with ``room`` left."""
    start = F.struct(rows.cast("long").alias("rows"), F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("pool"), F.array().cast("array<long>").alias("counts"))

    def take(s: Column, k: Column) -> Column:
        own = F.element_at(room, k + 1)
        return _bound(hypergeometric(s["pool"], own, s["rows"], _uniform(*of, k)), lambda x: F.struct((s["rows"] - x).alias("rows"), (s["pool"] - own).alias("pool"), F.concat(s["counts"], F.array(x)).alias("counts")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, take)["counts"]


def communication_matrix(sizes: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """sizes: (part int from 0, rows long), a row a partition.  Adds counts: array<long>, rows by shard; each shard's counts
    add up to its exact size."""
    parts = (sizes.agg(F.max("part")).first()[0] or 0) + 1
    levels = 0
    while 1 << (FAN_BITS * levels) < parts:
        levels += 1
    whole = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.expr(f"n div {shards}") + F.when(k < F.col("n") % shards, 1).otherwise(0).cast("long"))
    above = whole.select(F.lit(0).cast("int").alias("node"), room.alias("counts"))
    for level in range(1, levels + 1):
        shift = FAN_BITS * (levels - level)
        children = sizes.groupBy(F.shiftright("part", shift).alias("child")).agg(F.sum("rows").alias("rows"))
        groups = children.groupBy(F.shiftright("child", FAN_BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "rows"))).alias("children"))

        def deal(s: Column, c: Column) -> Column:
            line = _line(s["room"], c["rows"], shards, F.lit(seed), F.lit(shift), c["child"])  # noqa: B023
            return _bound(line, lambda x: F.struct(F.zip_with(s["room"], x, lambda a, b: a - b).alias("room"), F.concat(s["out"], F.array(F.struct(c["child"].alias("node"), x.alias("counts")))).alias("out")))

        start = F.struct(F.col("counts").alias("room"), F.array().cast("array<struct<node:int,counts:array<bigint>>>").alias("out"))
        above = groups.join(above, "node").select(F.explode(F.aggregate("children", start, deal)["out"]).alias("o")).select("o.node", "o.counts")
    return above.withColumnRenamed("node", "part")


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with shard (int, 0 .. shards - 1) and slot (long, gapless from 0 in each shard)."""
    names = {c: f"c{i}__" for i, c in enumerate(rows.columns) if c not in ("shard", "slot")}
    first = written(rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("at")), "sharding")
    placed = first.withColumn("part", F.shiftright("at", 33).cast("int"))
    sizes = written(placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "sharding-sizes")
    matrix = written(communication_matrix(sizes, shards, seed), "sharding-matrix")
    bounds = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("counts", 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "at"), "at")
    dealt = placed.join(matrix.select("part", bounds.alias("bounds")), "part").withColumn("rank", F.row_number().over(local) - 1)
    dealt = dealt.withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("rank")))).drop("bounds", "rank", "part")
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(seed), F.lit("slot"), "at"))
    dealt = written(dealt.withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKETS.bit_length() + 1).cast("int")), "sharding-dealt")
    forget(first, sizes, matrix)
    buckets = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "at")
    out = dealt.join(buckets, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.row_number().over(within) - 1).cast("long"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows as Parquet, a folder a shard, its files in the order of the slots."""
    shuffled(rows, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
