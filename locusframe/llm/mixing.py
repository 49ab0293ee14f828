"""Mixing sources to target weights: a time-varying curriculum over all documents, in built-in functions only.

Each source has a weight, which sets how many words the mix takes from it, and a schedule, a piecewise linear
intensity over training time 0..1, which sets when it takes them.  A source's documents stand in a fixed pseudo-random
order (by MD5 of doc_id); the mix walks through that order again and again until the source's target is reached, so the
k-th word demanded of a source is a known word of a known document.  The integral of the schedule says which share of
the target is demanded by time t; its inverse gives each document's training position.

Nulls and odd cases: a null text has size 0, takes 0 words and has no position; a null source is a source of its own,
ranked last; a null doc_id is hashed as the empty text; repeated rows are separate documents; an empty table gives an
empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import keeps_columns, n_words, table, written

#: Times a source may be repeated at most.
MAX_REPEATS = 3
#: Intensities at times 0, 1/2 and 1 for sources of weight 1, 2 and 3: light ones come early, heavy ones late.
SCHEDULES = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.5, 1.0, 1.5)}
#: Hexadecimal digits of the order key that name a block of a source's order.
BLOCK_DIGITS = 3


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes: (source, source_size), a row a source.  Adds weight and target.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...  Targets share the sum of all sizes by weight, stop at
    ``max_repeats`` times the source's size, and what is cut off is shared again by weight: target = min(cap, level *
    weight), with the one level at which they add up.  The windows without a key run over one row a source.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats).withColumn("_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("_at", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - below) / left
    ranked = ranked.withColumn("_level", level)
    level = F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(everything)
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "weight", "target")


def _segments(schedules: dict[int, tuple[float, ...]]) -> Column:
    """Array of (from, width, w0, w1, before, whole) for the row's weight; before: the integral up to the segment."""
    out = F.lit(None)
    for weight, knots in schedules.items():
        width = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * width for a, b in zip(knots, knots[1:])]
        parts = [
            F.struct(
                F.lit(i * width).alias("t"), F.lit(width).alias("width"), F.lit(float(knots[i])).alias("w0"),
                F.lit(float(knots[i + 1])).alias("w1"), F.lit(sum(areas[:i], 0.0)).alias("before"), F.lit(sum(areas)).alias("whole"),
            )
            for i in range(len(areas))
        ]
        out = F.when(F.col("weight") == weight, F.array(*parts)).otherwise(out)
    return out


def _position(demanded: Column, segments: Column) -> Column:
    """Time at which the share ``demanded`` of the target has been taken: the inverse of the schedule's integral."""
    area = demanded * segments[0]["whole"]
    s = F.element_at(F.filter(segments, lambda x: x["before"] <= area), -1)
    d = area - s["before"]
    return s["t"] + 2 * d / (s["w0"] + F.sqrt(s["w0"] * s["w0"] + 2 * (s["w1"] - s["w0"]) / s["width"] * d))


def mix(docs: DataFrame, size: Column, max_repeats: int = MAX_REPEATS, schedules: dict[int, tuple[float, ...]] = SCHEDULES) -> DataFrame:
    """Mix ``docs`` (doc_id, source, and what ``size`` needs): a row a document with doc_id, source, size, source_size,
    target, taken (words the mix takes, repeats counted), passes (times it is begun), position (0..1, of the first
    pass; null if never taken) and positions (of each pass in turn), range-sorted by position.

    taken is size for each whole pass over the source; in the last, broken pass the document in which the target is
    reached gives only the words still demanded, so each source's taken words are its target, rounded.

    No task gets a whole source: running sums are taken within (source, block of the order), offset by the sums of the
    blocks before.
    """
    slim = written(docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key")), "mixing")
    slim = slim.withColumns({"_no_source": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_block": F.substring("_key", 1, BLOCK_DIGITS)})
    group = ["_no_source", "_source", "_block"]
    blocks = slim.groupBy(*group).agg(F.sum("size").alias("_sum"))
    sources = blocks.groupBy("_no_source", "_source").agg(F.sum("_sum").alias("source_size"))
    sources = source_targets(sources.select(F.when(~F.col("_no_source"), F.col("_source")).alias("source"), "source_size"), max_repeats)
    sources = sources.withColumns({"_no_source": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_segments": _segments(schedules)}).drop("source")
    before = Window.partitionBy("_no_source", "_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(sources, ["_no_source", "_source"])
    within = Window.partitionBy(*group).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.withColumn("_within", F.sum("size").over(within) - F.col("size")).join(blocks.drop("_sum"), group)
    rows = rows.withColumns({"_at": F.col("_before") + F.col("_within"), "_goal": F.round("target").cast("long")})
    rows = rows.withColumn("_full", F.when(F.col("source_size") > 0, F.expr("_goal div source_size")).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("_rest", F.col("_goal") - F.col("_full") * F.col("source_size"))
    rows = rows.withColumn("_last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_at"))))
    rows = rows.withColumns({
        "taken": (F.col("_full") * F.col("size") + F.col("_last")).cast("long"),
        "passes": F.when(F.col("size") > 0, F.col("_full") + F.when(F.col("_last") > 0, 1).otherwise(0)).otherwise(0).cast("long"),
    })
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, _position(F.col("_at") / F.col("_goal"), F.col("_segments"))))
    every = F.transform(F.sequence(F.lit(1).cast("long"), F.col("passes")), lambda p: _position(((p - 1) * F.col("source_size") + F.col("_at")) / F.col("_goal"), F.col("_segments")))
    rows = rows.withColumn("positions", F.when(F.col("taken") > 0, every).otherwise(F.array().cast("array<double>")))
    # those never taken come last, spread by their key
    last = F.coalesce("position", 1 + F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2**32)
    return rows.orderBy(last).select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position", "positions")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", "text"), n_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("position", 9).alias("position"))


@keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a row for each pass over a document, whole, so the document that reaches a target counts fully;
    documents that are not taken go; those without a word take nothing and stay once.  Rows are range-sorted by the
    position of their pass, those without a word come last."""
    columns = docs.columns
    whole = docs.withColumns({"_id": F.col("doc_id"), "_text": F.xxhash64("text", "source", "lang")})
    mixed = mix(docs.select("doc_id", "source", "text"), n_words(F.col("text")))
    copies = mixed.withColumn("times", F.when(F.col("size") == 0, F.array(F.lit(None).cast("double"))).otherwise(F.col("positions"))).filter("size(times) > 0")
    copies = copies.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("passes"))).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_n", "times")
    whole = whole.withColumn("_size", n_words(F.col("text"))).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("_text")))
    on = whole["_id"].eqNullSafe(copies["_id"]) & whole["source"].eqNullSafe(copies["_source"]) & (whole["_size"] == copies["_size"]) & (whole["_n"] == copies["_n"])
    joined = whole.join(copies, on).select(*[whole[c] for c in columns], F.explode("times").alias("_time"))
    return joined.orderBy(F.col("_time").asc_nulls_last(), F.xxhash64("doc_id", "text")).select(*columns)


ORACLE = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sized),
capped AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight::DOUBLE AS r FROM ranked),
levels AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
       / (sum(weight) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM capped),
targets AS (SELECT source, source_size, weight, least(cap::DOUBLE, (max(CASE WHEN lev <= r THEN lev END) OVER ()) * weight::DOUBLE) AS target FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.weight, t.target, floor(t.target + 0.5)::BIGINT AS goal,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - s.size AS a
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS f FROM placed),
ended AS (SELECT *, greatest(0, least(size, goal - f * source_size - a)) AS l FROM passed),
done AS (
  SELECT *, CASE WHEN size > 0 THEN f + CASE WHEN l > 0 THEN 1 ELSE 0 END ELSE 0 END AS passes, f * size + l AS taken,
         CASE weight WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE weight WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS w2,
         a::DOUBLE / nullif(goal, 0)::DOUBLE AS share FROM ended),
cut AS (SELECT *, share >= (w0 + 1.0::DOUBLE) / 4 AS late, (w0 + 1.0::DOUBLE) / 4 AS first_area FROM done),
seg AS (SELECT *, CASE WHEN late THEN share - first_area ELSE share END AS d, CASE WHEN late THEN 1.0::DOUBLE ELSE w0 END AS u, CASE WHEN late THEN w2 ELSE 1.0::DOUBLE END AS v FROM cut)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, passes::BIGINT AS passes,
       CASE WHEN taken > 0 THEN round((CASE WHEN late THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) + 2 * d / (u + sqrt(u * u + 2 * (v - u) / 0.5::DOUBLE * d)), 9) END AS position
FROM seg
"""
