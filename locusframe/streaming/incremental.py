"""Allele counts kept up to date while variant lines arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allele_counts(lines: DataFrame) -> DataFrame:
    """lines: a stream of (value), records whose first FORMAT field is GT.  Counts by (chrom, pos, ref, allele number), for
    a sink in update or complete mode."""
    columns = F.split(F.rtrim("value"), "\t")
    gts = F.transform(F.slice(columns, 10, F.greatest(F.size(columns) - 9, F.lit(0))), lambda t: F.split(F.substring_index(t, ":", 1), r"[/|]"))
    rows = lines.filter(~F.col("value").startswith("#")).select(F.get(columns, F.lit(0)).alias("chrom"), F.get(columns, F.lit(1)).try_cast("int").alias("pos"), F.upper(F.get(columns, F.lit(3))).alias("ref"), F.explode(F.flatten(gts)).alias("a"))
    return rows.withColumn("allele_idx", F.col("a").try_cast("int")).filter("allele_idx is not null").groupBy("chrom", "pos", "ref", "allele_idx").agg(F.count("*").alias("count"))
