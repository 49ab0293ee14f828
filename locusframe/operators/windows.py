"""Statistics by position windows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import is_biallelic_snp, is_transition, ratio
from locusframe.operators.counts import biallelic, in_windows
from locusframe.schema import Cohort


def _filled(bins: DataFrame, first: Column, value: list[str]) -> DataFrame:
    """Adds the empty bins of each chromosome between ``first`` and the last one."""
    ends = bins.groupBy("chrom").agg(first.alias("lo"), F.max("bin").alias("hi"))
    every = ends.select("chrom", F.explode(F.sequence("lo", "hi")).alias("bin"))
    return every.join(bins, ["chrom", "bin"], "left").na.fill(0, value)


def snp_density(cohort: Cohort, size: int) -> DataFrame:
    """Variants in tumbling bins of ``size`` bases; records in a row at one position count once."""
    s = cohort.sites.filter(F.size("alt") > 0)
    before = F.lag("pos").over(Window.partitionBy("chrom").orderBy("line_no"))
    s = s.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("pos")))
    bins = s.groupBy("chrom", F.floor(F.col("pos") / size).alias("bin")).agg(F.count("*").alias("n_variants"))
    out = _filled(bins, F.min("bin"), ["n_variants"])
    return out.select("chrom", (F.col("bin") * size).alias("bin_start"), "n_variants", (F.col("n_variants") / (size / 1000.0)).alias("per_kb"))


def _substitutions(cohort: Cohort) -> DataFrame:
    s = cohort.sites.filter(is_biallelic_snp()).withColumn("a", F.get("alt", F.lit(0)))
    s = s.filter(F.col("ref").isin(*"ACGT") & F.col("a").isin(*"ACGT") & (F.col("ref") != F.col("a")))
    return s.withColumn("ts", is_transition(F.col("ref"), F.col("a")).cast("long"))


def ts_tv(cohort: Cohort, size: int) -> DataFrame:
    """Transitions over transversions of biallelic SNPs in tumbling bins, from bin 0; 0 where there is no transversion."""
    bins = _substitutions(cohort).groupBy("chrom", F.floor(F.col("pos") / size).alias("bin")).agg(F.count("*").alias("n_snps"), F.sum("ts").alias("n_ts"))
    out = _filled(bins, F.lit(0).cast("long"), ["n_snps", "n_ts"])
    return out.select("chrom", (F.col("bin") * size).alias("bin_start"), "n_snps", F.coalesce(ratio(F.col("n_ts"), F.col("n_snps") - F.col("n_ts")), F.lit(0.0)).alias("ts_tv"))


def ts_tv_summary(cohort: Cohort) -> DataFrame:
    """Counts of the six kinds of substitution, of transitions and of transversions."""
    spark = cohort.sites.sparkSession
    s = _substitutions(cohort).withColumn("model", F.concat(F.least("ref", "a"), F.greatest("ref", "a")))
    rows = s.select(F.explode(F.array("model", F.when(F.col("ts") == 1, "Ts").otherwise("Tv"))).alias("model")).groupBy("model").count()
    every = spark.createDataFrame([(m,) for m in ("AC", "AG", "AT", "CG", "CT", "GT", "Ts", "Tv")], "model string")
    return every.join(rows, "model", "left").select("model", F.coalesce("count", F.lit(0)).alias("n"))


def ts_tv_by_count(cohort: Cohort) -> DataFrame:
    """By the count of the ALT allele, for those that occur."""
    counts = biallelic(cohort, diploid=False).select("site_id", F.col("n_alt").alias("alt_count"))
    per = _substitutions(cohort).join(counts, "site_id").groupBy("alt_count").agg(F.sum("ts").alias("n_ts"), F.sum(1 - F.col("ts")).alias("n_tv"))
    return per.withColumn("ts_tv", ratio(F.col("n_ts"), F.col("n_tv")))


def ts_tv_by_quality(cohort: Cohort) -> DataFrame:
    """For each QUAL: the counts strictly below and strictly above it.  Running sums go over the whole numbers of QUAL, then over
    the values within each."""
    per = _substitutions(cohort).filter("qual is not null").groupBy("qual").agg(F.sum("ts").alias("ts"), F.sum(1 - F.col("ts")).alias("tv")).withColumn("whole", F.floor("qual"))
    wholes = per.groupBy("whole").agg(F.sum("ts").alias("all_ts"), F.sum("tv").alias("all_tv"))
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    before, every = Window.orderBy("whole").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wholes = wholes.select("whole", *[f(f"all_{c}", w).alias(f"{n}_{c}") for c in ("ts", "tv") for f, w, n in ((zero, before, "below"), (zero, every, "total"))])
    within = Window.partitionBy("whole").orderBy("qual").rowsBetween(Window.unboundedPreceding, -1)
    out = per.withColumns({"own_ts": zero("ts", within), "own_tv": zero("tv", within)}).join(wholes, "whole")
    out = out.select("qual", *[(F.col(f"below_{c}") + F.col(f"own_{c}")).alias(f"n_{c}_lt") for c in ("ts", "tv")], *[(F.col(f"total_{c}") - F.col(f"below_{c}") - F.col(f"own_{c}") - F.col(c)).alias(f"n_{c}_gt") for c in ("ts", "tv")])
    return out.withColumns({"ratio_lt": ratio(F.col("n_ts_lt"), F.col("n_tv_lt")), "ratio_gt": ratio(F.col("n_ts_gt"), F.col("n_tv_gt"))})


def tajima_d(cohort: Cohort, size: int) -> DataFrame:
    """Tajima's D of biallelic diploid sites in tumbling bins, with two chromosomes a kept sample."""
    n = 2 * cohort.samples.count()
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / a1**2
    e1, e2 = c1 / a1, c2 / (a1**2 + a2)
    s = biallelic(cohort).filter("n_ref > 0 and n_alt > 0").withColumn("p", F.col("n_ref") / (F.col("n_ref") + F.col("n_alt")))
    bins = s.groupBy("chrom", F.floor(F.col("pos") / size).alias("bin")).agg(F.count("*").alias("n_snps"), F.sum(2 * F.col("p") * (1 - F.col("p"))).alias("x"))
    bins = _filled(bins, F.min("bin"), ["n_snps", "x"])
    s_, pi = F.col("n_snps"), F.col("x") * n / (n - 1)
    d = F.when(s_ > 0, (pi - s_ / a1) / F.sqrt(e1 * s_ + e2 * s_ * (s_ - 1)))
    return bins.select("chrom", (F.col("bin") * size).alias("bin_start"), "n_snps", d.alias("tajima_d"))


def window_pi(cohort: Cohort, size: int, step: int) -> DataFrame:
    """Diversity in sliding windows: mismatching pairs over all pairs, sites without variant counted as monomorphic."""
    n = F.lit(2 * cohort.samples.count()).cast("long")
    s = biallelic(cohort).withColumns({"t": F.col("n_ref") + F.col("n_alt"), "mismatch": 2 * F.col("n_ref") * F.col("n_alt")}).filter("n_ref < t")
    rows = s.select("chrom", "pos", "t", "mismatch", in_windows(F.col("pos"), size, step).alias("k"))
    per = rows.groupBy("chrom", "k").agg(F.count("*").alias("n_variants"), F.sum("mismatch").alias("mismatches"), F.sum(F.col("t") * (F.col("t") - 1)).alias("pairs"))
    per = per.withColumn("pairs", F.col("pairs") + (size - F.col("n_variants")) * n * (n - 1))
    step = size if step <= 0 or step > size else step
    return per.select("chrom", (F.col("k") * step + 1).cast("long").alias("bin_start"), (F.col("k") * step + size).cast("long").alias("bin_end"), "n_variants", ratio(F.col("mismatches"), F.col("pairs")).alias("pi"))


def _fst_parts(cohort: Cohort, populations: DataFrame) -> DataFrame:
    """Weir and Cockerham's a and a + b + c of each diploid site, summed over its alleles.  populations: (sample_id, pop)."""
    calls = cohort.calls.filter("included and a1 is not null and a2 is not null").join(populations, "sample_id")
    diploid = cohort.calls.groupBy("site_id").agg(F.bool_and((F.col("ploidy") == 2) | ~F.col("included")).alias("d")).filter("d").select("site_id")
    calls = calls.join(diploid, "site_id")
    r = populations.select("pop").distinct().count()
    size = calls.groupBy("site_id", "pop").agg(F.count("*").alias("n"))
    seen = calls.select("site_id", "pop", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("allele"), (F.col("a1") != F.col("a2")).alias("het"))
    held = seen.groupBy("site_id", "pop", "allele").agg(F.sum(F.when(F.col("het"), 1).otherwise(2)).alias("copies"), F.count_if("het").alias("hets"))
    every = held.select("site_id", "allele").distinct().join(size, "site_id").join(held, ["site_id", "pop", "allele"], "left").na.fill(0, ["copies", "hets"])
    t = every.groupBy("site_id", "allele").agg(F.sum("n").alias("sn"), F.sum(F.col("n") * F.col("n")).alias("sn2"), F.sum("copies").alias("sc"), F.sum("hets").alias("sh"), F.sum(F.col("copies") * F.col("copies") / (4.0 * F.col("n"))).alias("sp2"), F.count("*").alias("pops"))
    t = t.filter(F.col("pops") == r)
    sn = F.col("sn").cast("double")
    nbar, p, h = sn / r, F.col("sc") / (2.0 * sn), F.col("sh") / sn
    s2 = (F.col("sp2") - sn * p * p) / ((r - 1) * nbar)
    nc = (sn - F.col("sn2") / sn) / (r - 1)
    inner = p * (1 - p) - (r - 1) / r * s2
    a = nbar / nc * (s2 - (inner - h / 4) / (nbar - 1))
    b = nbar / (nbar - 1) * (inner - h * (2 * nbar - 1) / (4 * nbar))
    parts = t.filter((nbar > 1) & (nc != 0)).select("site_id", a.alias("a"), (a + b + h / 2).alias("abc"))
    per = parts.groupBy("site_id").agg(F.sum("a").alias("a"), F.sum("abc").alias("abc"))
    return cohort.sites.select("site_id", "chrom", "pos").join(per, "site_id")


def weir_fst(cohort: Cohort, populations: DataFrame) -> DataFrame:
    return _fst_parts(cohort, populations).select("chrom", "pos", F.when(F.abs("abc") > 1e-12, F.col("a") / F.col("abc")).alias("fst"))


def windowed_fst(cohort: Cohort, populations: DataFrame, size: int, step: int) -> DataFrame:
    """Weighted (sum of a over sum of a + b + c) and mean Fst in sliding windows."""
    rows = _fst_parts(cohort, populations).filter(F.abs("abc") > 1e-12).withColumn("k", in_windows(F.col("pos"), size, step))
    step = size if step <= 0 or step > size else step
    per = rows.groupBy("chrom", "k").agg(F.count("*").alias("n_variants"), F.sum("a").alias("a"), F.sum("abc").alias("abc"), F.avg(F.col("a") / F.col("abc")).alias("mean_fst"))
    return per.select("chrom", (F.col("k") * step + 1).cast("long").alias("bin_start"), (F.col("k") * step + size).cast("long").alias("bin_end"), "n_variants", F.when(F.abs("abc") > 1e-12, F.col("a") / F.col("abc")).alias("weighted_fst"), "mean_fst")


def haplotype_counts(cohort: Cohort, bins: DataFrame, width: int = 1000) -> DataFrame:
    """Distinct haplotypes of phased biallelic sites in disjoint bins (chrom, start, end], the most frequent one's count, and
    groups: how many haplotypes occur how often, as count:haplotypes from the most frequent; empty bins of chromosomes with
    sites have zeros."""
    from locusframe.operators.intervals import containing

    s = biallelic(cohort).filter("all_phased").select("site_id", "chrom", "pos")
    hit = containing(s, bins, width).select("site_id", "pos", "chrom", "start", "end")
    calls = cohort.calls.filter("included").select("site_id", "sample_id", F.explode(F.array(F.struct(F.lit(1).alias("copy"), F.col("a1").alias("x")), F.struct(F.lit(2).alias("copy"), F.col("a2").alias("x")))).alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "site_id", F.coalesce(F.col("c.x").cast("string"), F.lit(".")).alias("x")))), lambda v: v["x"]), "")
    haps = calls.join(hit, "site_id").groupBy("chrom", "start", "end", "sample_id", "c.copy").agg(text.alias("haplotype"))
    sizes = haps.groupBy("chrom", "start", "end", "haplotype").agg(F.count("*").alias("n"))
    alike = sizes.groupBy("chrom", "start", "end", "n").agg(F.count("*").alias("k"))
    groups = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n", "k")))), lambda g: F.concat_ws(":", g["n"].cast("string"), g["k"].cast("string"))), ",")
    per = alike.groupBy("chrom", "start", "end").agg(F.sum("k").alias("n_unique"), F.max("n").alias("largest"), groups.alias("groups"))
    sites = hit.groupBy("chrom", "start", "end").agg(F.count("*").alias("n_snps"))
    visited = bins.join(s.select("chrom").distinct(), "chrom", "left_semi")
    return visited.join(sites, ["chrom", "start", "end"], "left").join(per, ["chrom", "start", "end"], "left").na.fill(0, ["n_snps", "n_unique", "largest"]).na.fill("", ["groups"]).select("chrom", "start", "end", "n_snps", "n_unique", "largest", "groups")


def indel_lengths(cohort: Cohort) -> DataFrame:
    """Histogram of ALT length minus REF length over ACGT alleles; substitutions of one base stand at 0."""
    rows = cohort.sites.select("ref", F.explode("alt").alias("alt")).filter(F.col("alt").rlike("^[ACGTN]+$"))
    size = F.length("alt") - F.length("ref")
    rows = rows.filter((size != 0) | (F.length("ref") == 1)).groupBy(size.alias("length")).agg(F.count("*").alias("n"))
    return rows.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
