"""Operators on the records of one cohort: annotation, filters with names, subsets, summaries, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import event_type, hwe_exact, is_indel, is_snp, is_transition, normalize_alleles, ratio
from locusframe.functions.fields import as_diploid, likeliest, reploided
from locusframe.operators.counts import allele_counts, biallelic, called, site_totals
from locusframe.operators.intervals import containing
from locusframe.operators.stretches import runs
from locusframe.schema import Cohort


def annotate(cohort: Cohort, intervals: DataFrame, tag: str, value: str | None = None, width: int = 1000) -> DataFrame:
    """intervals: (chrom, start, end, ...), start exclusive.  Sites with INFO ``tag`` set to the values of the column
    ``value`` of all intervals they lie in, joined by commas (or to the flag 1), as info text."""
    hit = containing(cohort.sites.select("site_id", "chrom", "pos"), intervals, width)
    values = hit.groupBy("site_id").agg((F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",") if value else F.lit("1")).alias("_v"))
    out = cohort.sites.join(values, "site_id", "left")
    rest = F.map_filter("info", lambda k, v: k != tag)
    return out.withColumn("info", F.when(F.col("_v").isNotNull(), F.map_concat(rest, F.create_map(F.lit(tag), F.col("_v")))).otherwise(F.col("info"))).drop("_v")


def annotate_columns(cohort: Cohort, table: DataFrame, width: int = 1000) -> DataFrame:
    """table: chrom, from, to (both inclusive), perhaps ref and alt, and values named id, qual, filter or after INFO keys.

    A site takes the values of the rows that hold its position and, where the table has alleles, whose normalised alleles
    are those of one of its ALTs.  Several values of a key are joined by commas in order (of qual the largest is taken); '.'
    removes what the site has; null leaves it."""
    values = [c for c in table.columns if c not in ("chrom", "from", "to", "ref", "alt")]
    own = cohort.sites.select("site_id", "chrom", "pos", *([F.col("ref").alias("_ref"), F.col("alt").alias("_alt")] if "ref" in table.columns else []))
    hit = containing(own, table.withColumnRenamed("to", "end").withColumn("start", F.col("from") - 1).drop("from"), width)
    if "ref" in table.columns:
        wanted = normalize_alleles(F.upper("ref"), F.upper("alt"))
        hit = hit.filter(F.exists("_alt", lambda a: normalize_alleles(F.col("_ref"), a) == wanted))
    per = hit.groupBy("site_id").agg(*[(F.max("qual") if v == "qual" else F.nullif(F.array_join(F.array_sort(F.collect_set(F.col(v).cast("string"))), ","), F.lit(""))).alias(f"_{v}") for v in values])
    out = cohort.sites.join(per, "site_id", "left")
    gone = lambda v: F.col(f"_{v}") == "."
    if "id" in values:
        out = out.withColumn("id", F.when(gone("id"), F.lit(None)).otherwise(F.coalesce("_id", "id")))
    if "qual" in values:
        out = out.withColumn("qual", F.coalesce("_qual", "qual"))
    if "filter" in values:
        out = out.withColumn("filter", F.when(gone("filter"), F.array().cast("array<string>")).when(F.col("_filter").isNotNull(), F.split("_filter", "[,;]")).otherwise(F.col("filter")))
    for v in values:
        if v not in ("id", "qual", "filter"):
            rest = F.map_filter("info", lambda k, _: k != v)  # noqa: B023
            out = out.withColumn("info", F.when(gone(v), rest).when(F.col(f"_{v}").isNotNull(), F.map_concat(rest, F.create_map(F.lit(v), F.col(f"_{v}")))).otherwise(F.col("info")))
    return out.drop(*[f"_{v}" for v in values])


def remove_columns(sites: DataFrame, info: list[str] = (), ids: bool = False, filters: bool = False) -> DataFrame:
    """Sites without the named INFO keys, ids or filters."""
    sites = sites.withColumn("info", F.map_filter("info", lambda k, v: ~k.isin(*info))) if info else sites
    sites = sites.withColumn("id", F.lit(None).cast("string")) if ids else sites
    return sites.withColumn("filter", F.array().cast("array<string>")) if filters else sites


def hard_filter(sites: DataFrame) -> DataFrame:
    """Sites that passed, or have no filter."""
    return sites.filter((F.size("filter") == 0) | (F.col("filter") == F.array(F.lit("PASS"))))


def normalise(sites: DataFrame) -> DataFrame:
    """Sites with one ALT in their shortest form, the position moved with a start that is cut off; others as they are."""
    short = normalize_alleles(F.col("ref"), F.get("alt", F.lit(0)))
    one = F.size("alt") == 1
    return sites.withColumn("_n", F.when(one, short)).withColumns({"pos": F.when(one, F.col("pos") + F.col("_n.shift")).otherwise(F.col("pos")), "ref": F.when(one, F.col("_n.ref")).otherwise(F.col("ref")), "alt": F.when(one, F.array("_n.alt")).otherwise(F.col("alt"))}).drop("_n")


def local_rules(**limits: float) -> dict[str, Column]:
    """Rules for ``named_filters`` by their usual names, with limits: MinDP, MaxDP, MinMQ, MinAB, Qual, VDB, HWE, and
    StrandBias, BaseQualBias, MapQualBias and EndDistBias (least p values), and HWE_G3 (least HWE with more heterozygotes
    than expected by the genotype frequencies G3).  RefN takes any.  A site without the INFO key passes."""
    info = lambda k: F.element_at("info", k).try_cast("double")
    item = lambda k, i: F.get(F.split(F.element_at("info", k), ","), F.lit(i)).try_cast("double")
    p = item("G3", 0) + item("G3", 1) / 2
    rules = {
        "MinDP": lambda x: info("DP") < x, "MaxDP": lambda x: info("DP") > x, "MinMQ": lambda x: info("MQ") < x, "MinAB": lambda x: item("DP4", 2) + item("DP4", 3) < x, "Qual": lambda x: F.col("qual") < x,
        "VDB": lambda x: info("VDB") < x, "HWE": lambda x: info("HWE") < x, "HWE_G3": lambda x: (info("HWE") < x) & (p > 0) & (p < 1) & (item("G3", 1) > 2 * p * (1 - p)), "RefN": lambda x: F.upper("ref").contains("N"),
        **{name: (lambda x, i=i: item("PV4", i) < x) for i, name in enumerate(("StrandBias", "BaseQualBias", "MapQualBias", "EndDistBias"))},
    }
    return {name: rules[name](x) for name, x in limits.items()}


def shuffle_columns(cohort: Cohort, names: list[str]) -> Cohort:
    """The cohort with its samples in the order of ``names``, which has each of them once."""
    order = cohort.samples.sparkSession.createDataFrame(list(enumerate(names)), "sample_idx int, sample_id string")
    return cohort.with_(samples=cohort.samples.select("sample_id").join(order, "sample_id"))


def info_text(info: Column) -> Column:
    """key=value in the order of the keys; '.' if empty."""
    parts = F.transform(F.array_sort(F.map_keys(info)), lambda k: F.concat_ws("=", k, F.element_at(info, k)))
    return F.when(F.size(info) == 0, ".").otherwise(F.array_join(parts, ";"))


def fill_counts(cohort: Cohort) -> DataFrame:
    """AN and the list AC of the called alleles."""
    return fill_counts_by_site(cohort).drop("site_id")


def fill_counts_by_site(cohort: Cohort) -> DataFrame:
    rows = allele_counts(cohort)
    per = rows.groupBy("site_id", "chrom", "pos").agg(F.first("n_called").alias("an"), F.array_sort(F.collect_list(F.struct("allele_idx", "count"))).alias("x"))
    return per.select("site_id", "chrom", "pos", "an", F.array_join(F.transform(F.filter("x", lambda v: v["allele_idx"] > 0), lambda v: v["count"].cast("string")), ",").alias("ac"))


def fill_statistics(cohort: Cohort) -> DataFrame:
    """Exact Hardy-Weinberg p and the inbreeding coefficient 1 - observed / expected heterozygotes, biallelic diploid."""
    s = biallelic(cohort).filter("r + h + a > 0").withColumn("n", F.col("r") + F.col("h") + F.col("a"))
    p = (2 * F.col("r") + F.col("h")) / (2.0 * F.col("n"))
    return s.select("chrom", "pos", hwe_exact(F.col("r"), F.col("h"), F.col("a"))["p_hwe"].alias("hwe"), (1 - ratio(F.col("h"), 2 * p * (1 - p) * F.col("n"))).alias("icf"))


def fill_type(cohort: Cohort) -> DataFrame:
    """The kind of every ALT."""
    return cohort.sites.select("chrom", "pos", "ref", F.explode("alt").alias("alt")).withColumn("type", event_type(F.col("ref"), F.col("alt")))


def named_filters(sites: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the name of every rule that holds to FILTER; PASS goes where one does and comes where FILTER was empty."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    old = F.filter("filter", lambda f: f != "PASS")
    every = F.array_sort(F.array_union(old, failed))
    return sites.withColumn("filter", F.when(F.size(every) == 0, F.array(F.lit("PASS"))).otherwise(every))


def snp_gap(cohort: Cohort, width: int) -> DataFrame:
    """SNPs within ``width`` bases of an indel."""
    indels = cohort.sites.filter(is_indel() & (F.size("alt") > 0)).select("chrom", (F.col("pos") - width - 1).alias("start"), (F.col("pos") + F.length("ref") - 1 + width).alias("end"))
    snps = cohort.sites.filter(is_snp())
    return containing(snps, indels, how="left_semi").select("chrom", "pos")


def gap_window(cohort: Cohort, width: int) -> DataFrame:
    """Indels that share a run (gaps of at most ``width`` bases) with one of higher ALT frequency."""
    counts = allele_counts(cohort).filter("allele_idx > 0").groupBy("site_id").agg(F.max(F.col("count") / F.greatest("n_called", F.lit(1))).alias("af"))
    s = cohort.sites.filter(is_indel() & (F.size("alt") > 0)).join(counts, "site_id")
    s = runs(s, ["chrom"], F.col("pos") + width + 1, ["site_id"])
    best = F.row_number().over(Window.partitionBy("chrom", "run").orderBy(F.desc("af"), "pos", "site_id"))
    return s.withColumn("rank", best).filter("rank > 1").select("chrom", "pos")


def snp_cluster(cohort: Cohort, n: int, width: int) -> DataFrame:
    """SNPs of which some ``width`` bases that hold them hold at least ``n``."""
    by = Window.partitionBy("chrom").orderBy("pos")
    s = cohort.sites.filter(is_snp()).withColumn("ahead", F.count("*").over(by.rangeBetween(0, width - 1)))
    return s.withColumn("most", F.max("ahead").over(by.rangeBetween(-(width - 1), 0))).filter(F.col("most") >= n).select("chrom", "pos")


def subset(cohort: Cohort, samples: DataFrame, private: bool = False, exclude_reference: bool = False, types: tuple[str, ...] | None = None, trim: bool = False) -> DataFrame:
    """Sites with the ALT alleles that ``samples`` carry.  ``private``: only alleles that no other sample carries."""
    mine = samples.select("sample_id").withColumn("mine", F.lit(True))
    rows = called(cohort.calls).join(mine, "sample_id", "left").filter("allele > 0")
    per = rows.groupBy("site_id", "allele").agg(F.count_if("mine").alias("own"), F.count_if(F.col("mine").isNull()).alias("other")).filter("own > 0")
    if private:
        per = per.filter("other = 0")
    per = per.groupBy("site_id").agg(F.array_sort(F.collect_set("allele")).alias("carried"))
    out = cohort.sites.join(per, "site_id", "inner" if private or exclude_reference else "left")
    if types is not None:
        out = out.filter(F.exists("alt", lambda a: event_type(F.col("ref"), a).isin(*types)))
    kept = F.transform(F.coalesce("carried", F.array().cast("array<int>")), lambda i: F.get("alt", i - 1)) if trim else F.col("alt")
    return out.select("chrom", "pos", "ref", F.array_join(kept, ",").alias("alt"))


def contrast(cohort: Cohort, cases: list[str], controls: list[str], min_depth: int = 0) -> DataFrame:
    """Genotypes of ``cases`` with an allele that no control has: novel alleles and the cases that carry them.  A site with a
    control below ``min_depth`` (no depth counts as 0) is left out, uncalled controls are ignored, and a site without a called
    control has nothing to report."""
    rows = cohort.calls.filter(F.col("sample_id").isin(*cases, *controls)).withColumn("case", F.col("sample_id").isin(*cases))
    known = F.col("included") & (F.col("a1").isNotNull() | F.col("a2").isNotNull())
    told = rows.groupBy("site_id").agg(F.min(F.when(~F.col("case"), F.coalesce("dp", F.lit(0)))).alias("least"), F.count_if(~F.col("case") & known).alias("n_known"))
    told = told.filter((F.col("n_known") > 0) & (F.col("least") >= min_depth)).select("site_id")
    each = rows.filter("included").select("site_id", "sample_id", "case", F.explode(F.array_compact(F.array("a1", "a2"))).alias("allele"))
    per = each.groupBy("site_id", "allele").agg(F.count_if(~F.col("case")).alias("n_controls"), F.array_sort(F.collect_set(F.when(F.col("case"), F.col("sample_id")))).alias("carriers"))
    per = per.filter((F.col("n_controls") == 0) & (F.size("carriers") > 0)).join(told, "site_id")
    named = cohort.sites.join(per, "site_id").withColumn("novel", F.coalesce(F.get(F.concat(F.array("ref"), F.col("alt")), F.col("allele")), F.lit(".")))
    return named.select("chrom", "pos", "novel", F.array_join("carriers", ",").alias("carriers"))


def novelty(cohort: Cohort, cases: list[str], controls: list[str], min_depth: int = 0, passed_only: bool = False) -> DataFrame:
    """(site_id, chrom, pos, novelty, novel_alleles, novel_genotypes): how surely ``cases`` differ from ``controls``.

    Where the site's FORMAT has PL, a genotype is the likeliest one by PL (of a haploid list that allele twice), and a case
    and a control are as unlike as the least sum of their PL for one genotype; else they are 255 unlike, or 0 with equal
    genotypes.  A case counts as unlike its likest control; novelty is the least of that over the cases that are unlike all
    controls.  novel_alleles: such cases with an allele that no known control has; if there are none, novel_genotypes:
    cases whose genotype is not that of every known control.  A site without ALT, with a control below ``min_depth`` (none
    counts as 0), or where no case differs, is left out; unknown cases and controls are ignored."""
    sites = cohort.sites.filter(F.size("alt") > 0)
    if passed_only:
        sites = hard_filter(sites)
    sites = sites.select("site_id", "chrom", "pos", (F.size("alt") + 1).alias("_n"), F.array_contains("format", "PL").alias("_pl"))
    rows = cohort.calls.filter(F.col("sample_id").isin(*cases, *controls)).join(sites, "site_id")
    text = F.when(F.col("_pl"), F.element_at("fmt", "PL"))
    likely = likeliest(text, F.col("_n"))
    second = F.coalesce("a2", F.when(F.col("ploidy") == 1, F.col("a1")))
    called_ = F.col("included") & F.col("a1").isNotNull() & second.isNotNull()
    gt = F.when(F.col("_pl"), F.when(likely.isNotNull(), F.array(likely["j"], likely["i"]))).otherwise(F.when(called_, F.array_sort(F.array(F.col("a1"), F.when(F.col("ploidy") == 1, F.col("a1")).otherwise(F.col("a2"))))))
    one = F.struct(F.col("sample_id").alias("name"), F.col("sample_id").isin(*cases).alias("case"), gt.alias("gt"), as_diploid(text, F.col("_n")).alias("pl"), F.coalesce("dp", F.lit(0)).alias("dp"), F.col("_pl").alias("by_pl"))
    per = rows.groupBy("site_id", "chrom", "pos").agg(F.sort_array(F.collect_list(one)).alias("all"))
    per = per.withColumns({"shallow": F.exists("all", lambda c: ~c["case"] & (c["dp"] < min_depth)), "known": F.filter("all", lambda c: ~c["case"] & c["gt"].isNotNull())})
    unlike = lambda a, b: F.when(a["by_pl"], F.array_min(F.zip_with(a["pl"], b["pl"], lambda x, y: x + y))).otherwise(F.when(a["gt"] == b["gt"], 0.0).otherwise(255.0))
    each = F.transform(F.filter("all", lambda c: c["case"] & c["gt"].isNotNull()), lambda c: F.struct(
        c["name"].alias("name"), F.array_min(F.transform("known", lambda k: unlike(c, k))).alias("score"), F.exists("known", lambda k: k["gt"] != c["gt"]).alias("genotype"),
        (F.size(F.array_except(c["gt"], F.flatten(F.transform("known", lambda k: k["gt"])))) > 0).alias("allele")))
    per = per.filter(~F.col("shallow") & (F.size("known") > 0)).withColumn("each", each)
    names = lambda ok: F.array_join(F.transform(F.filter("each", ok), lambda e: e["name"]), ",")
    alleles_ = names(lambda e: e["allele"] & (e["score"] > 0))
    out = per.select(
        "site_id", "chrom", "pos", F.array_min(F.transform(F.filter("each", lambda e: e["score"] > 0), lambda e: e["score"])).cast("int").alias("novelty"), alleles_.alias("novel_alleles"),
        F.when(alleles_ == "", names(lambda e: e["genotype"])).otherwise("").alias("novel_genotypes"),
    )
    return out.filter(F.col("novelty").isNotNull() & ((F.col("novel_alleles") != "") | (F.col("novel_genotypes") != "")))


def mark_novel(cohort: Cohort, found: DataFrame) -> DataFrame:
    """Sites with what ``novelty`` found as INFO NOVELTY and NOVELAL or NOVELGT."""
    out = cohort.sites.join(found.drop("chrom", "pos"), "site_id", "left")
    own = F.create_map(F.lit("NOVELTY"), F.col("novelty").cast("string"), F.lit("NOVELAL"), F.nullif("novel_alleles", F.lit("")), F.lit("NOVELGT"), F.nullif("novel_genotypes", F.lit("")))
    rest = F.map_filter("info", lambda k, v: ~k.isin("NOVELTY", "NOVELAL", "NOVELGT"))
    return out.withColumn("info", F.when(F.col("novelty").isNotNull(), F.map_concat(rest, F.map_filter(own, lambda k, v: v.isNotNull()))).otherwise(F.col("info"))).drop("novelty", "novel_alleles", "novel_genotypes")


def summary(cohort: Cohort) -> DataFrame:
    """Counts by FILTER value and over all (a null filter_text): sites, SNPs, indels, multi-allelic, transitions."""
    s = cohort.sites.withColumn("filter_text", F.when(F.size("filter") == 0, ".").otherwise(F.array_join("filter", ";")))
    first = F.get("alt", F.lit(0))
    return s.rollup("filter_text").agg(
        F.count("*").alias("n_sites"), F.count_if(is_snp()).alias("n_snps"), F.count_if(is_indel() & (F.size("alt") > 0)).alias("n_indels"), F.count_if(F.size("alt") > 1).alias("n_multi"),
        F.count_if(is_snp() & is_transition(F.col("ref"), first)).alias("n_ts"),
    )


def sample_summary(cohort: Cohort) -> DataFrame:
    """By sample: sites with an ALT, of which private to it, homozygous, heterozygous, phased calls."""
    rows = cohort.calls.filter("included and a1 is not null")
    carries = (F.col("a1") > 0) | (F.coalesce("a2", F.lit(0)) > 0)
    n = rows.filter(carries).groupBy("site_id").agg(F.count("*").alias("carriers"))
    rows = rows.join(n, "site_id", "left")
    return rows.groupBy("sample_id").agg(
        F.count_if(carries).alias("n_alt_sites"), F.count_if(carries & (F.col("carriers") == 1)).alias("n_private"), F.count_if(carries & (F.col("a1") == F.col("a2"))).alias("n_hom"),
        F.count_if(F.col("a2").isNotNull() & (F.col("a1") != F.col("a2"))).alias("n_het"), F.count_if("phased").alias("n_phased"),
    )


def shared_counts(cohort: Cohort) -> DataFrame:
    """How many sites as many samples share: n_samples that carry an ALT, n_sites, and of them SNPs and indels."""
    carries = (F.col("a1") > 0) | (F.coalesce("a2", F.lit(0)) > 0)
    per = cohort.calls.filter("included").filter(carries).groupBy("site_id").agg(F.count("*").alias("n_samples"))
    return cohort.sites.join(per, "site_id").groupBy("n_samples").agg(F.count("*").alias("n_sites"), F.count_if(is_snp()).alias("n_snps"), F.count_if(is_indel()).alias("n_indels"))


def substitutions(cohort: Cohort) -> DataFrame:
    """Counts of single-base changes from REF, by every ALT."""
    rows = cohort.sites.select("ref", F.explode("alt").alias("alt")).filter("length(ref) = 1 and length(alt) = 1 and ref <> alt")
    return rows.groupBy("ref", "alt").agg(F.count("*").alias("n"))


def ts_tv(cohort: Cohort) -> DataFrame:
    """One row: transitions, transversions and their ratio of the first ALTs of one base, and what was left out."""
    first = F.get("alt", F.lit(0))
    base = (F.size("alt") > 0) & (F.length("ref") == 1) & (F.length(first) == 1) & (F.col("ref") != first)
    ts = base & is_transition(F.col("ref"), first)
    out = cohort.sites.agg(F.count_if(ts).alias("n_ts"), F.count_if(base & ~ts).alias("n_tv"), F.count("*").alias("n_total"), F.count_if(~F.coalesce(base, F.lit(False))).alias("n_skipped"), F.count_if(F.size("alt") > 1).alias("n_multi"))
    return out.withColumn("ts_tv", ratio(F.col("n_ts"), F.col("n_tv")))


def indel_frames(cohort: Cohort, exons: DataFrame) -> DataFrame:
    """Indels of the first ALT inside and outside exons (chrom, start, end]: in frame and shifting it."""
    s = cohort.sites.filter(F.size("alt") > 0).withColumn("len", F.length(F.get("alt", F.lit(0))) - F.length("ref")).filter("len <> 0")
    inside = containing(s.select("site_id", "chrom", "pos"), exons, how="left_semi").select("site_id").withColumn("exonic", F.lit(True))
    s = s.join(inside, "site_id", "left").withColumn("exonic", F.coalesce("exonic", F.lit(False)))
    return s.groupBy("exonic").agg(F.count("*").alias("n_indels"), F.count_if(F.col("len") % 3 == 0).alias("n_inframe"), F.count_if(F.col("len") % 3 != 0).alias("n_frameshift"))


def fix_ploidy(cohort: Cohort, regions: DataFrame, sexes: DataFrame, likelihoods: bool = False) -> DataFrame:
    """regions: (chrom, start, end, sex, ploidy), start exclusive; sexes: (sample_id, sex).  Calls with the ploidy that their
    region and sex ask for: the first allele alone, or twice; ploidy 0 makes a known call missing and haploid.

    ``likelihoods``: PL and GL follow (from diploid to haploid the homozygous values, back '.' for heterozygous genotypes),
    and a changed call is the likeliest one by PL, or else GL, of what is left; adds fmt."""
    hit = containing(cohort.sites.select("site_id", "chrom", "pos", (F.size("alt") + 1).alias("_n")), regions).select("site_id", "sex", "_n", F.col("ploidy").cast("int").alias("wanted")).distinct()
    calls = cohort.calls.join(sexes, "sample_id", "left").join(hit, ["site_id", "sex"], "left")
    known = F.col("a1").isNotNull() | F.col("a2").isNotNull()
    removed = (F.col("wanted") == 0) & known
    changed = F.col("wanted").isNotNull() & (F.col("wanted") > 0) & (F.col("wanted") != F.col("ploidy"))
    ploidy = F.when(removed, 1).when(changed, F.col("wanted")).otherwise(F.col("ploidy").cast("int"))
    first, second = F.col("a1"), F.when(F.col("wanted") == 1, F.lit(None)).when((F.col("wanted") == 2) & (F.col("ploidy") == 1), F.col("a1")).otherwise(F.col("a2"))
    out = calls.withColumns({"_removed": removed, "_changed": changed, "_new": ploidy, "_was": F.col("ploidy"), "_first": first, "_second": second})
    if likelihoods:
        lists = lambda k: reploided(F.element_at("fmt", k), F.col("_n"), F.col("_was"), F.when(F.col("_removed"), 1).otherwise(F.col("wanted")))
        moved = F.coalesce((F.col("_removed") & (F.col("_was") == 2)) | F.col("_changed"), F.lit(False))
        # of a haploid list its best allele; lists of '.' for heterozygous genotypes are read by their homozygous values
        best = lambda k, sign: likeliest(F.when(F.col("_new") == 2, reploided(lists(k), F.col("_n"), F.lit(2), F.lit(1))).otherwise(lists(k)), F.col("_n"), sign)["i"]
        chosen = F.coalesce(best("PL", 1), best("GL", -1), F.col("_first"))
        out = out.withColumn("_first", F.when(F.col("_changed"), chosen).otherwise(F.col("_first")))
        out = out.withColumn("_second", F.when(F.col("_changed"), F.when(F.col("_new") == 2, chosen)).otherwise(F.col("_second")))
        value = lambda k, v: F.when(k == "PL", lists("PL")).when(k == "GL", lists("GL")).otherwise(v)
        out = out.withColumn("fmt", F.when(moved, F.transform_values("fmt", value)).otherwise(F.col("fmt")))
    a1 = F.when(~F.coalesce("_removed", F.lit(False)), F.col("_first"))
    a2 = F.when(~F.coalesce("_removed", F.lit(False)), F.col("_second"))
    return out.select("site_id", "sample_id", a1.alias("a1"), a2.alias("a2"), F.col("_new").alias("ploidy"), *(["fmt"] if likelihoods else []))


def validate(cohort: Cohort, info: set[str] = frozenset(), flags: set[str] = frozenset()) -> DataFrame:
    """(line_no, rule, detail): rows out of order, repeated positions, bad bases, genotypes without an allele, AN and AC
    that the calls contradict, values that are not of their declared type or number, and INFO keys or FILTER names that the header
    doesn't declare."""
    types = {f.id: f for f in cohort.fields if f.kind == "INFO"}
    mistyped = lambda t: lambda x: (x != ".") & x.try_cast(t).isNull()
    info = info or set(types)
    flags = flags or {f.id for f in cohort.fields if f.kind == "FILTER"}
    s = cohort.sites
    order = Window.partitionBy("chrom").orderBy("line_no")
    before = s.withColumn("was", F.lag("pos").over(order))
    found = [
        before.filter("pos < was").select("line_no", F.lit("unsorted").alias("rule"), F.concat_ws(":", "chrom", "pos").alias("detail")),
        before.filter("pos = was").select("line_no", F.lit("duplicate"), F.concat_ws(":", "chrom", "pos")),
        s.filter(~F.col("ref").rlike("^[ACGTNacgtn]+$")).select("line_no", F.lit("bad_ref"), "ref"),
        s.select("line_no", F.explode("alt").alias("a")).filter(~F.col("a").rlike(r"^([ACGTNacgtn*]+|<.+>|.*[\[\]].*)$")).select("line_no", F.lit("bad_alt"), "a"),
        s.select("line_no", "ref", F.explode("alt").alias("a")).filter("ref = a").select("line_no", F.lit("alt_is_ref"), "a"),
        s.select("line_no", F.explode(F.map_keys("info")).alias("k")).filter(~F.col("k").isin(*info) if info else F.lit(False)).select("line_no", F.lit("undeclared_info"), "k"),
        s.select("line_no", F.explode("filter").alias("k")).filter((F.col("k") != "PASS") & (~F.col("k").isin(*flags) if flags else F.lit(False))).select("line_no", F.lit("undeclared_filter"), "k"),
        *[
            s.filter(F.map_contains_key("info", k)).select("line_no", F.element_at("info", k).alias("v")).filter(F.exists(F.split("v", ","), mistyped("int" if f.type == "Integer" else "double")))
            .select("line_no", F.lit("bad_type"), F.concat(F.lit(f"{k}="), "v"))
            for k, f in types.items() if f.type in ("Integer", "Float")
        ],
        *[
            s.filter(F.map_contains_key("info", k)).select("line_no", F.element_at("info", k).alias("v"), (F.size("alt") if f.number == "A" else F.size("alt") + 1 if f.number == "R" else F.lit(int(f.number) if f.number.isdigit() else 0)).alias("n"))
            .filter(F.size(F.split("v", ",")) != F.col("n")).select("line_no", F.lit("bad_number"), F.concat(F.lit(f"{k}="), "v"))
            for k, f in types.items() if f.type != "Flag" and (f.number in ("A", "R") or f.number.isdigit() and f.number != "0")
        ],
        fill_counts_by_site(cohort).join(s.select("site_id", "line_no", F.element_at("info", "AN").alias("_an"), F.element_at("info", "AC").alias("_ac")), "site_id").filter("_an <> cast(an as string) or _ac <> ac").select("line_no", F.lit("bad_an_ac"), F.concat_ws(";", "_an", "_ac")),
        cohort.calls.join(s.select("site_id", "line_no", F.size("alt").alias("n")), "site_id").filter("a1 > n or a2 > n").select("line_no", F.lit("no_such_allele"), "sample_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def validate_header(cohort: Cohort) -> DataFrame:
    """(line_no, rule, detail) of the header's own lines, from 1: no fileformat line, or one that is not the first; declarations
    without ID, Number, Type or Description, of a Type or Number that there is not, or repeated; columns that are missing or
    in another order, and sample names given twice."""
    found, seen = [], set()
    lines = cohort.header
    formats = [i for i, h in enumerate(lines, 1) if h.startswith("##fileformat=")]
    if not formats:
        found.append((1, "no_fileformat", ""))
    elif formats[0] != 1:
        found.append((formats[0], "fileformat_not_first", lines[formats[0] - 1]))
    for i, h in enumerate(lines, 1):
        if m := re.match(r"##(INFO|FORMAT|FILTER)=(.*)", h):
            own = dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2][1:-1])) if m[2].startswith("<") and m[2].endswith(">") else {}
            wanted = ["ID", "Description"] if m[1] == "FILTER" else ["ID", "Number", "Type", "Description"]
            found += [(i, "missing_key", f"{m[1]}:{k}") for k in wanted if k not in own]
            if m[1] != "FILTER" and own.get("Type", "String") not in (["Integer", "Float", "Character", "String"] + ["Flag"] * (m[1] == "INFO")):
                found.append((i, "bad_declared_type", own["Type"]))
            if m[1] != "FILTER" and not re.fullmatch(r"\d+|-1|[.ARG]", own.get("Number", "1")):
                found.append((i, "bad_declared_number", own["Number"]))
            if "ID" in own and (m[1], own["ID"]) in seen:
                found.append((i, "declared_twice", own["ID"]))
            seen.add((m[1], own.get("ID")))
    columns = [(i, h.split("\t")) for i, h in enumerate(lines, 1) if h.startswith("#CHROM")]
    fixed = "#CHROM POS ID REF ALT QUAL FILTER INFO".split()
    if not columns:
        found.append((len(lines) + 1, "no_columns", ""))
    else:
        i, names = columns[0]
        if names[:8] != fixed or len(names) > 8 and names[8] != "FORMAT":
            found.append((i, "bad_columns", " ".join(names[:9])))
        found += [(i, "sample_twice", s) for s in sorted({s for s in names[9:] if names[9:].count(s) > 1})]
    return cohort.sites.sparkSession.createDataFrame(found, "line_no long, rule string, detail string")


def validate_calls(cohort: Cohort) -> DataFrame:
    """(line_no, rule, detail) of FORMAT columns: keys that no header line declares, GT not in the first place, values that are
    not of their declared type, and lists of another length than their Number asks for (by genotype as the call's ploidy
    has it); detail is sample:key=value."""
    declared = {f.id: f for f in cohort.fields if f.kind == "FORMAT"}
    s = cohort.sites.select("site_id", "line_no", "format", F.size("alt").alias("n_alt"))
    keys = s.select("line_no", F.explode("format").alias("k"))
    out = keys.filter(~F.col("k").isin(*declared) if declared else F.lit(True)).select("line_no", F.lit("undeclared_format").alias("rule"), F.col("k").alias("detail"))
    out = out.union(s.filter(F.array_position("format", "GT") > 1).select("line_no", F.lit("gt_not_first"), F.array_join("format", ":")))
    values = cohort.calls.join(s.drop("format"), "site_id").select("line_no", "sample_id", "n_alt", "ploidy", F.explode("fmt").alias("k", "v")).filter("v is not null and v <> '.'")
    said = F.concat(F.col("sample_id"), F.lit(":"), F.col("k"), F.lit("="), F.col("v"))
    items = F.split("v", ",")
    n = F.col("n_alt") + 1
    wrong, long = F.lit(False), F.lit(False)
    for k, f in declared.items():
        if f.type in ("Integer", "Float"):
            wrong = wrong | ((F.col("k") == k) & F.exists(items, lambda x: (x != ".") & x.try_cast("int" if f.type == "Integer" else "double").isNull()))  # noqa: B023
        count = {"A": n - 1, "R": n, "G": F.when(F.col("ploidy") == 1, n).otherwise(n * (n + 1) / 2)}.get(f.number) if not f.number.isdigit() else F.lit(int(f.number))
        if count is not None and k != "GT":
            long = long | ((F.col("k") == k) & (F.size(items) != count))
    return out.union(values.filter(wrong).select("line_no", F.lit("bad_format_type"), said)).union(values.filter(long).select("line_no", F.lit("bad_format_number"), said))


def phased_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: (sample_id, chrom, pos, a1, a2), phased calls of two overlapping pieces.  By sample and chromosome:
    shared heterozygous calls that match and that are swapped, and whether the right piece has to be swapped."""
    both = left.alias("l").join(right.alias("r"), ["sample_id", "chrom", "pos"]).filter("l.a1 <> l.a2 and r.a1 <> r.a2")
    same = (F.col("l.a1") == F.col("r.a1")) & (F.col("l.a2") == F.col("r.a2"))
    crossed = (F.col("l.a1") == F.col("r.a2")) & (F.col("l.a2") == F.col("r.a1"))
    marked = both.select("sample_id", "chrom", "pos", same.alias("same"), crossed.alias("crossed")).filter("same or crossed")
    site = Window.partitionBy("chrom", "pos")
    n = F.count("*").over(site)
    p = F.least(F.greatest(F.count_if("crossed").over(site) / n, 1 / n), 1 - 1 / n)
    p = F.when(n == 1, 0.25).otherwise(p)
    marked = marked.withColumn("p", p)
    agree, differ = F.log(F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))), F.log(2 * F.col("p") * (1 - F.col("p")))
    per = marked.groupBy("sample_id", "chrom").agg(F.count_if("same").alias("n_match"), F.count_if("crossed").alias("n_swapped"), F.sum(F.when(F.col("same"), agree).otherwise(differ)).alias("keep_likelihood"), F.sum(F.when(F.col("same"), differ).otherwise(agree)).alias("swap_likelihood"))
    return per.withColumns({"swap": F.col("swap_likelihood") > F.col("keep_likelihood"), "quality": F.abs(F.col("swap_likelihood") - F.col("keep_likelihood")) / 2.302585092994046})


def joined_calls(left: DataFrame, right: DataFrame, least_quality: float = 0.0) -> DataFrame:
    """left, right: as for ``phased_join``.  The calls of both pieces, the right one's swapped where that is more likely, with
    their phase set ps: the first position of the left piece, or of the right one where nothing, or less than
    ``least_quality``, tells how they join.  Calls of both pieces are the left one's."""
    by = ["sample_id", "chrom"]
    per = phased_join(left, right).filter(F.col("quality") >= least_quality).select(*by, "swap")
    starts = left.groupBy(*by).agg(F.min("pos").alias("_left")).join(right.groupBy(*by).agg(F.min("pos").alias("_right")), by, "full").join(per, by, "left")
    rest = right.join(left, [*by, "pos"], "left_anti").withColumn("_mine", F.lit(False))
    rows = left.withColumn("_mine", F.lit(True)).unionByName(rest).join(starts, by)
    turned = ~F.col("_mine") & F.coalesce("swap", F.lit(False))
    new = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
    return rows.select(*by, "pos", new("a1", "a2"), new("a2", "a1"), F.when(F.col("_mine") | F.col("swap").isNotNull(), F.col("_left")).otherwise(F.col("_right")).alias("ps"))
