"""Statistics of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import hwe_exact, is_transition, ratio
from locusframe.operators.counts import allele_counts, biallelic
from locusframe.schema import Cohort


def frequencies(cohort: Cohort, derived: bool = False) -> DataFrame:
    """Frequency and count of every allele.  ``derived``: the ancestral allele (INFO AA) comes first, and sites whose
    ancestral allele is unknown or not among their alleles are left out."""
    rows = allele_counts(cohort).withColumn("freq", ratio(F.col("count"), F.col("n_called")))
    if derived:
        ancestral = cohort.sites.select("site_id", F.upper(F.col("info")["AA"]).alias("aa"))
        rows = rows.join(ancestral, "site_id")
        has = F.max((F.col("allele") == F.col("aa")).cast("int")).over(Window.partitionBy("site_id"))
        rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.when(F.col("allele") == F.col("aa"), 0).otherwise(1), "allele_idx")) - 1
        rows = rows.withColumn("has", has).withColumn("allele_idx", rank).filter("has = 1").drop("has", "aa")
    return rows.select("chrom", "pos", "allele_idx", "allele", "n_chr", "n_called", "count", "freq")


def hardy(cohort: Cohort) -> DataFrame:
    """Observed and expected genotype counts, chi-square and exact p values of biallelic diploid sites."""
    s = biallelic(cohort)
    n = (F.col("r") + F.col("h") + F.col("a")).cast("double")
    f = (2 * F.col("r") + F.col("h")) / (2 * n)
    s = s.filter("r + h + a > 0").withColumns({"e_r": f * f * n, "e_h": 2 * f * (1 - f) * n, "e_a": (1 - f) * (1 - f) * n})
    part = lambda o, e: F.when(F.col(e) > 0, (F.col(o) - F.col(e)) * (F.col(o) - F.col(e)) / F.col(e)).otherwise(0.0)
    s = s.withColumns({"chisq": part("r", "e_r") + part("h", "e_h") + part("a", "e_a"), "p": hwe_exact(F.col("r"), F.col("h"), F.col("a"))})
    return s.select("chrom", "pos", "r", "h", "a", "e_r", "e_h", "e_a", "chisq", "p.p_hwe", "p.p_lo", "p.p_hi")


def missing(cohort: Cohort) -> DataFrame:
    """N_DATA (chromosomes; one for a haploid call), how many were masked, how many are missing, and their share."""
    haploid = F.col("ploidy") == 1
    chromosomes = F.when(haploid, 1).otherwise(2)
    gone = F.when(~F.col("included"), 0).otherwise(F.col("a1").isNull().cast("int") + F.when(haploid, 0).otherwise(F.col("a2").isNull().cast("int")))
    per = cohort.calls.groupBy("site_id").agg(F.sum(chromosomes).alias("n_data"), F.sum(F.when(F.col("included"), 0).otherwise(chromosomes)).alias("n_filtered"), F.sum(gone).alias("n_miss"))
    per = per.withColumn("f_miss", ratio(F.col("n_miss"), F.col("n_data") - F.col("n_filtered")))
    return cohort.sites.join(per, "site_id").select("chrom", "pos", "n_data", "n_filtered", "n_miss", "f_miss")


def depth(cohort: Cohort) -> DataFrame:
    """Sum and sum of squares of the depths of a site."""
    dp = F.when(F.col("included") & (F.col("dp") >= 0), F.col("dp").cast("long"))
    per = cohort.calls.groupBy("site_id").agg(F.coalesce(F.sum(dp), F.lit(0)).alias("sum_depth"), F.coalesce(F.sum(dp * dp), F.lit(0)).alias("sumsq_depth"))
    return cohort.sites.join(per, "site_id").select("chrom", "pos", "sum_depth", "sumsq_depth")


def mean_depth(cohort: Cohort) -> DataFrame:
    """Mean and unbiased variance of the known depths; null where fewer than one or two are known."""
    dp = F.when(F.col("included") & (F.col("dp") >= 0), F.col("dp").cast("long"))
    per = cohort.calls.groupBy("site_id").agg(F.count(dp).alias("n"), F.sum(dp).alias("s"), F.sum(dp * dp).alias("q"))
    per = per.withColumns({"mean_depth": ratio(F.col("s"), F.col("n")), "var_depth": ratio(F.col("q") * F.col("n") - F.col("s") * F.col("s"), F.col("n") * (F.col("n") - 1))})
    return cohort.sites.join(per, "site_id").select("chrom", "pos", "mean_depth", "var_depth")


def genotype_depth(cohort: Cohort, samples: list[str]) -> DataFrame:
    """A column of depths a sample, -1 where unknown or masked.  The samples are named, so no pass looks for them."""
    known = cohort.calls.withColumn("d", F.coalesce(F.when(F.col("included"), F.col("dp")), F.lit(-1)))
    wide = known.groupBy("site_id").pivot("sample_id", samples).agg(F.first("d"))
    return cohort.sites.select("site_id", "chrom", "pos").join(wide, "site_id").drop("site_id").na.fill(-1, samples)


def quality(cohort: Cohort) -> DataFrame:
    return cohort.sites.select("chrom", "pos", "qual")


def singletons(cohort: Cohort) -> DataFrame:
    """Alleles that occur once (S), or twice in one homozygous call (D), and who carries them."""
    calls = cohort.calls.filter("included").join(cohort.samples, "sample_id")
    rows = calls.select("site_id", "sample_id", "sample_idx", F.explode(F.array_compact(F.array("a1", "a2"))).alias("allele_idx"))
    per = rows.groupBy("site_id", "allele_idx").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("carriers"), F.min_by("sample_id", "sample_idx").alias("sample_id"))
    per = per.filter("n = 1 or (n = 2 and carriers = 1)").withColumn("kind", F.when(F.col("n") == 1, "S").otherwise("D"))
    named = cohort.sites.join(per, "site_id").withColumn("allele", F.get(F.concat(F.array("ref"), F.col("alt")), F.col("allele_idx")))
    return named.select("chrom", "pos", "kind", "allele", "sample_id")


def pi(cohort: Cohort) -> DataFrame:
    """Nucleotide diversity of diploid sites: sum over alleles of c (T - c) / (T (T - 1))."""
    rows = allele_counts(cohort)
    diploid = cohort.calls.groupBy("site_id").agg(F.bool_and((F.col("ploidy") == 2) | ~F.col("included")).alias("d")).filter("d")
    per = rows.groupBy("site_id", "chrom", "pos").agg(F.sum(F.col("count") * (F.col("n_called") - F.col("count"))).alias("x"), F.first("n_called").alias("t"))
    return per.join(diploid, "site_id", "left_semi").select("chrom", "pos", ratio(F.col("x"), F.col("t") * (F.col("t") - 1)).alias("pi"))


def removed(cohort: Cohort, kept: Cohort) -> DataFrame:
    """Sites that a filter has removed."""
    return cohort.sites.join(kept.sites.select("site_id"), "site_id", "left_anti").select("chrom", "pos")


def filter_summary(cohort: Cohort) -> DataFrame:
    """Variants, transitions, transversions and their ratio for each FILTER value (first ALT of substitutions)."""
    s = cohort.sites.withColumns({"filter_text": F.when(F.size("filter") == 0, ".").otherwise(F.array_join("filter", ";")), "first_alt": F.get("alt", F.lit(0))})
    base = (F.length("ref") == 1) & (F.length("first_alt") == 1)
    ts = base & is_transition(F.col("ref"), F.col("first_alt"))
    per = s.groupBy("filter_text").agg(F.count("*").alias("n_variants"), F.count_if(ts).alias("n_ts"), F.count_if(base & ~ts & (F.col("ref") != F.col("first_alt"))).alias("n_tv"))
    return per.withColumn("ts_tv", ratio(F.col("n_ts"), F.col("n_tv"))).orderBy(F.desc("n_variants"), F.desc("filter_text"))


def mendel(cohort: Cohort, trios: DataFrame) -> DataFrame:
    """trios: (family, child, father, mother).  Calls of a child that its parents' cannot give."""
    full = cohort.calls.filter("included and a1 is not null and a2 is not null").select("site_id", "sample_id", "a1", "a2")
    who = lambda k: full.select("site_id", F.col("sample_id").alias(k), F.col("a1").alias(f"{k}1"), F.col("a2").alias(f"{k}2"))
    rows = who("child").join(trios, "child").join(who("father"), ["site_id", "father"]).join(who("mother"), ["site_id", "mother"])
    of = lambda x, k: F.col(x).isin(F.col(f"{k}1"), F.col(f"{k}2"))
    fits = (of("child1", "father") & of("child2", "mother")) | (of("child2", "father") & of("child1", "mother"))
    text = lambda k: F.concat_ws("/", F.col(f"{k}1"), F.col(f"{k}2")).alias(f"{k}_gt")
    return rows.filter(~fits).join(cohort.sites, "site_id").select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "family", text("child"), text("father"), text("mother"))
