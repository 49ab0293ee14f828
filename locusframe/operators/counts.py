"""Counts that most statistics start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.alleles import alleles, n_alleles
from locusframe.schema import Cohort


def called(calls: DataFrame) -> DataFrame:
    """(site_id, sample_id, allele): a row a non-missing allele of calls that are not masked."""
    return calls.filter("included").select("site_id", "sample_id", F.explode(F.array_compact(F.array("a1", "a2"))).alias("allele"))


def allele_counts(cohort: Cohort) -> DataFrame:
    """A row an allele of a site (REF is 0): allele_idx, allele, count, n_called (alleles called), n_chr."""
    counts = called(cohort.calls).groupBy("site_id", F.col("allele").alias("allele_idx")).agg(F.count("*").alias("count"))
    totals = site_totals(cohort.calls)
    every = cohort.sites.select("site_id", "chrom", "pos", F.posexplode(alleles()).alias("allele_idx", "allele"))
    rows = every.join(counts, ["site_id", "allele_idx"], "left").join(totals, "site_id", "left")
    return rows.select("site_id", "chrom", "pos", "allele_idx", "allele", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("n_called", F.lit(0)).alias("n_called"), F.coalesce("n_chr", F.lit(0)).alias("n_chr"))


def site_totals(calls: DataFrame) -> DataFrame:
    """n_called: alleles called; n_chr: chromosomes, masked calls too; diploid: every call that counts has two."""
    own = F.when(F.col("included"), F.col("a1").isNotNull().cast("int") + F.col("a2").isNotNull().cast("int")).otherwise(0)
    return calls.groupBy("site_id").agg(F.sum(own).cast("long").alias("n_called"), F.sum("ploidy").cast("long").alias("n_chr"), F.bool_and((F.col("ploidy") == 2) | ~F.col("included")).alias("diploid"))


def biallelic(cohort: Cohort, diploid: bool = True) -> DataFrame:
    """Sites with one ALT (and, if ``diploid``, no haploid call): n_ref, n_alt alleles and r, h, a genotypes."""
    ok, a1, a2 = F.col("included"), F.col("a1"), F.col("a2")
    count = lambda c: F.count_if(ok & c)
    per = cohort.calls.groupBy("site_id").agg(
        (count(a1 == 0) + count(a2 == 0)).alias("n_ref"), (count(a1 == 1) + count(a2 == 1)).alias("n_alt"),
        count((a1 == 0) & (a2 == 0)).alias("r"), count(a1.isNotNull() & a2.isNotNull() & (a1 != a2)).alias("h"), count((a1 == 1) & (a2 == 1)).alias("a"),
        F.bool_and((F.col("ploidy") == 2) | ~ok).alias("diploid"), F.bool_and(F.col("phased") | ~ok).alias("all_phased"),
    )
    sites = cohort.sites.filter(n_alleles() == 2).join(per, "site_id")
    return sites.filter("diploid") if diploid else sites


def in_windows(pos, size: int, step: int):
    """Numbers k of all windows [k*step + 1, k*step + size] that hold ``pos``."""
    step = size if step <= 0 or step > size else step
    first = F.greatest(F.lit(0), F.ceil((pos - size) / step)).cast("int")
    last = (F.ceil(pos / step) - 1).cast("int")
    return F.explode(F.sequence(first, last))
