"""Side tables: intervals, positions, sample lists, trios, masks and sequences, read by Spark from any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.stretches import running


def _columns(spark: SparkSession, path: str, names: list[str], skip_first: bool, comment: str | None = "#") -> DataFrame:
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    if skip_first:
        rows = rows.filter(F.col("n") > 0)
    if comment:
        rows = rows.filter(~F.col("value").startswith(comment))
    parts = F.split(F.trim("value"), r"\s+")
    return rows.filter(F.length(F.trim("value")) > 0).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start (exclusive), end; the first line is a heading."""
    return _columns(spark, path, ["chrom", "start", "end"], True, None).selectExpr("chrom", "try_cast(start AS int) AS start", "try_cast(end AS int) AS end").filter("start is not null and end is not null")


def positions(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark, path, ["chrom", "pos"], False).selectExpr("chrom", "try_cast(pos AS int) AS pos").filter("pos is not null")


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark, path, ["sample_id"], False, None)


def trios(spark: SparkSession, path: str) -> DataFrame:
    """family, child, father, mother; the first line is a heading."""
    return _columns(spark, path, ["family", "child", "father", "mother"], True, None)


def sequences(spark: SparkSession, path: str, value: str = "seq") -> DataFrame:
    """(chrom, start, seq) from a FASTA text file whose sequence lines have one length: a line is a chunk.  A line's sequence is
    the last heading before it, and its start the lengths of the sequence's lines before it, both by stretches of lines."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    head = F.col("value").startswith(">")
    name = F.struct("n", F.regexp_extract("value", r"^>(\S+)", 1).alias("chrom"))
    under = running(rows, [], [], {"_head": (F.when(head, name), "max")}, at="n")
    body = under.filter(~head & (F.length("value") > 0) & F.col("_head").isNotNull()).select("n", "value", F.col("_head.chrom").alias("chrom"))
    body = running(body, ["chrom"], [], {"_before": (F.length("value").cast("long"), "sum")}, at="n", before_only=True)
    return body.select("chrom", (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("start"), F.col("value").alias(value))


def mask(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, digits) from a FASTA-like file of digits."""
    return sequences(spark, path, "digits")


def contigs(spark: SparkSession, path: str) -> list[str]:
    """The lines of a file that declares contigs and nothing else."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    if wrong := rows.filter(~F.col("value").startswith("##contig=")).first():
        raise ValueError(f"a contigs file holds ##contig= lines only, not {wrong['value'][:80]!r}")
    return [r["value"] for r in rows.collect()]  # a line a contig
