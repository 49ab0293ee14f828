"""Joins of positions with intervals: an equality on chromosome and bin, so a chromosome's rows spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(sites: DataFrame, intervals: DataFrame, width: int = 1000, span: str | None = None, how: str = "inner") -> DataFrame:
    """Sites whose position (or whose bases pos .. pos + ``span`` - 1) meets an interval (chrom, start, end], with it.

    Both sides are laid out over bins of ``width`` bases.  "left_semi" and "left_anti" keep or drop the sites that meet
    any interval, each once; "inner" gives a row a pair.
    """
    last = F.col("pos") + (F.col(span) - 1 if span else 0)
    laid = sites.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(last / width))))
    others = intervals.withColumns({"_chrom": F.col("chrom")}).drop("chrom").filter(F.col("end") > F.col("start"))
    others = others.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") + 1) / width), F.floor(F.col("end") / width))))
    on = (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_b")) & (F.col("start") < last) & (F.col("end") >= F.col("pos"))
    if how == "inner":
        # a pair that shares several bins counts in the first of them
        first = F.greatest(F.floor(F.col("pos") / width), F.floor((F.col("start") + 1) / width)) == F.col("_bin")
        return laid.join(others, on & first).drop("_bin", "_b", "_chrom")
    met = laid.join(others, on, "left_semi").select("site_id").distinct()
    return sites.join(met, "site_id", how)
