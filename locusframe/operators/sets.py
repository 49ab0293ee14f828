"""Several inputs by position: intersections, concatenation, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import is_indel, is_snp
from locusframe.operators.stretches import runs
from locusframe.schema import Cohort


def tagged(cohorts: list[Cohort]) -> DataFrame:
    """All sites with src, the input's number from 1."""
    return reduce(DataFrame.unionByName, [c.sites.withColumn("src", F.lit(i)) for i, c in enumerate(cohorts, 1)])


def clusters(rows: DataFrame, gap: int) -> DataFrame:
    """Numbers positions of a chromosome that lie at most ``gap`` bases behind the one before alike (``cluster``: the first
    of them)."""
    return runs(rows, ["chrom"], F.col("pos") + gap + 1, ["src"]).withColumnRenamed("run", "cluster")


def intersect(cohorts: list[Cohort], least: int | None = None, exactly: int | None = None, most: int | None = None, gap: int = 0, passed_only: bool = False, first_only: bool = False) -> DataFrame:
    """Sites at positions that ``least``/``exactly``/``most`` inputs have, with sf, the inputs that have them.  ``gap``:
    positions up to so many bases apart count as one.  ``first_only``: the rows of the first input."""
    rows = tagged(cohorts)
    if passed_only:
        rows = rows.filter((F.size("filter") == 0) | (F.get("filter", F.lit(0)) == "PASS"))
    rows = clusters(rows, gap) if gap else rows.withColumn("cluster", F.col("pos").cast("long"))
    per = rows.groupBy("chrom", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda x: (x - 1).cast("string")), ",").alias("sf"), F.countDistinct("src").alias("n"), F.min("src").alias("first"))
    keep = F.lit(True)
    for bound, holds in ((least, lambda b: F.col("n") >= b), (exactly, lambda b: F.col("n") == b), (most, lambda b: F.col("n") <= b)):
        if bound is not None:
            keep = keep & holds(bound)
    out = rows.join(per.filter(keep), ["chrom", "cluster"])
    out = out.filter(F.col("src") == 1) if first_only else out.filter(F.col("src") == F.col("first"))
    return out.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "src", "sf")


def complement(first: Cohort, others: list[Cohort], gap: int = 0) -> DataFrame:
    """Sites that only the first input has."""
    return intersect([first, *others], exactly=1, gap=gap, first_only=True).select("chrom", "pos", "ref", "alt")


def venn(cohorts: list[Cohort]) -> DataFrame:
    """Number of positions for each combination of inputs."""
    rows = tagged(cohorts).groupBy("chrom", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda x: x.cast("string")), ",").alias("files"))
    return rows.groupBy("files").agg(F.count("*").alias("n_sites"))


def combinations(cohorts: list[Cohort], gap: int = 0) -> DataFrame:
    """(files, src, site_id): the records of the first input of each position (or cluster) by the inputs that have it, such as
    0_2; every position is in one combination."""
    rows = tagged(cohorts)
    rows = clusters(rows, gap) if gap else rows.withColumn("cluster", F.col("pos"))
    per = rows.groupBy("chrom", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda x: (x - 1).cast("string")), "_").alias("files"), F.min("src").alias("first"))
    return rows.join(per, ["chrom", "cluster"]).filter(F.col("src") == F.col("first")).select("files", "src", "site_id")


def write_combinations(cohorts: list[Cohort], path: str, gap: int = 0) -> None:
    """A folder of records for each combination of inputs, ``files=0_2``, which ``vcf.read`` reads: the lines of the combination's
    first input under that input's header."""
    from locusframe.sources import vcf

    found = combinations(cohorts, gap)
    spark = found.sparkSession
    lines = reduce(DataFrame.unionByName, [vcf.lines(c, numbered=True).join(found.filter(F.col("src") == i).select("files", "site_id"), "site_id") for i, c in enumerate(cohorts, 1)])
    heads = spark.createDataFrame([(i, k, h) for i, c in enumerate(cohorts, 1) for k, h in enumerate(vcf.head(c))], "src int, k int, value string")
    head = found.select("files", "src").distinct().join(heads, "src")
    head.repartition("files").sortWithinPartitions("files", "k").select("files", F.lit("header").alias("part"), "value").write.mode("append").partitionBy("files", "part").text(path)
    rows = lines.repartitionByRange("files", *natural_order("chrom"), "pos", "line_no").sortWithinPartitions("files", *natural_order("chrom"), "pos", "line_no")
    rows.select("files", F.lit("records").alias("part"), "value").write.mode("append").partitionBy("files", "part").text(path)


def concat(cohorts: list[Cohort]) -> DataFrame:
    """Rows of all inputs in the order of chromosome and position; columns that one lacks are null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.sites.withColumn("src", F.lit(i)) for i, c in enumerate(cohorts, 1)])
    return rows.orderBy(*natural_order("chrom"), "pos", "src")


def natural_order(chrom: str) -> list:
    """chr2 before chr10: the number in a name, then the name."""
    return [F.regexp_extract(chrom, r"^\D*(\d+)", 1).try_cast("int").asc_nulls_last(), F.col(chrom)]


def numbered(sites: DataFrame, width: int = 100_000) -> DataFrame:
    """Adds line, the number from 1 in the order of chromosome, position and site_id.  A number is the rank within a stretch of
    ``width`` bases and the counts of the stretches before; the window without a key has a row a stretch."""
    rows = sites.withColumn("_stretch", F.floor(F.col("pos") / width))
    before = Window.orderBy(*natural_order("chrom"), "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("chrom", "_stretch").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("chrom", "_stretch").orderBy("pos", "site_id"))
    return rows.withColumn("_rank", rank).join(counts, ["chrom", "_stretch"]).withColumn("line", F.col("_before") + F.col("_rank")).drop("_stretch", "_rank", "_before")


#: INFO keys that a merge sums, and those that it sums item by item.
SUMMED, ITEMS = ("DP", "MQ0"), ("DP4", "I16")


def _merged(cohorts: list[Cohort], collapse: str = "any", apart: bool = False) -> DataFrame:
    """A row a position and group of records that ``collapse`` takes as one: merged_ref, x (the inputs' rows in order: src,
    site_id, alts, filter, info, qual, weight, id, format) and the united ALTs.  ``apart``: of several records of one input
    that are alike, the first go together, the second and so on."""
    rows = reduce(DataFrame.unionByName, [c.sites.withColumns({"src": F.lit(i), "weight": F.lit(max(1, c.samples.count()))}) for i, c in enumerate(cohorts, 1)])
    same, alike = F.concat_ws(":", "ref", F.array_join("alt", ",")), {"snps": is_snp(), "indels": is_indel(), "both": is_snp() | is_indel(), "any": F.lit(True), "none": F.lit(False)}[collapse]
    rows = rows.withColumn("kind", F.when(alike, F.lit("") if collapse == "any" else F.when(is_snp(), "snp").otherwise("indel")).otherwise(same))
    if apart:
        again = F.row_number().over(Window.partitionBy("chrom", "pos", "kind", "src").orderBy("site_id"))
        rows = rows.withColumn("_again", again).withColumn("kind", F.when(F.col("_again") > 1, F.concat_ws("#", "kind", "_again")).otherwise(F.col("kind"))).drop("_again")
    rows = rows.withColumn("merged_ref", F.max_by("ref", F.struct(F.length("ref"), -F.col("src"))).over(Window.partitionBy("chrom", "pos", "kind")))
    rows = rows.withColumn("alts", F.transform("alt", lambda a: F.concat(a, F.substr("merged_ref", F.length("ref") + 1))))
    one = F.struct("src", "site_id", "alts", "filter", F.map_entries("info").alias("info"), "qual", "weight", "id", "format")
    per = rows.groupBy("chrom", "pos", "kind", "merged_ref").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return per.withColumn("alts", F.array_distinct(F.flatten(F.transform("x", lambda v: v["alts"]))))


def merge(cohorts: list[Cohort], collapse: str = "any") -> DataFrame:
    """Full outer merge by position.  ``collapse`` says which records at one position become one: any, only snps, indels
    or both (each with their like), or none but equal ones.  REF extended to the longest, ALTs united after the same extension, QUAL weighted by
    the inputs' samples (an input without samples counts as one), FILTER united without PASS, each INFO key from the first
    input that has it but for those that are summed, sf the inputs."""
    return _records(cohorts, collapse).drop("kind")


def _records(cohorts: list[Cohort], collapse: str) -> DataFrame:
    per = _merged(cohorts, collapse)
    flags = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("x", lambda v: v["filter"])), lambda f: f != "PASS")))
    total = lambda what: F.aggregate(F.filter("x", lambda v: v["qual"].isNotNull()), F.lit(0.0), lambda acc, v: acc + what(v))
    weight = total(lambda v: v["weight"])
    entries = F.flatten(F.transform("x", lambda v: v["info"]))
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    others = lambda k: F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: F.split(e["value"], ","))
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))

    def value(e: Column) -> Column:
        sums = F.aggregate(F.slice(others(e["key"]), F.lit(2), F.size(entries)), F.transform(F.split(e["value"], ","), number), lambda acc, v: F.zip_with(acc, v, lambda a, b: F.coalesce(a, F.lit(0)) + number(b)))
        return F.when(e["key"].isin(*SUMMED, *ITEMS), F.array_join(F.transform(sums, lambda n: n.cast("string")), ",")).otherwise(e["value"])

    info = F.array_join(F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["key"].alias("k"), F.concat_ws("=", e["key"], value(e)).alias("t")))), lambda x: x["t"]), ";")
    return per.select(
        "kind", "chrom", "pos", F.col("merged_ref").alias("ref"), F.array_join("alts", ",").alias("alt"), F.when(weight > 0, total(lambda v: v["qual"] * v["weight"]) / weight).alias("qual"), F.array_join(flags, ";").alias("filter"),
        F.when(info == "", ".").otherwise(info).alias("info"), F.array_join(F.transform("x", lambda v: (v["src"] - 1).cast("string")), ",").alias("sf"),
    )


def merge_calls(cohorts: list[Cohort], collapse: str = "any") -> DataFrame:
    """(chrom, pos, kind, sample_id, a1, a2, ploidy, phased): the calls of all inputs, numbered by the merged ALTs; masked calls
    are missing.  Where inputs share a sample's name, theirs get the input's number as a prefix."""
    names = reduce(DataFrame.unionByName, [c.samples.select("sample_id").withColumn("src", F.lit(i)) for i, c in enumerate(cohorts, 1)])
    shared = F.count("*").over(Window.partitionBy("sample_id")) > 1
    names = names.withColumn("name", F.when(shared, F.concat_ws("_", "src", "sample_id")).otherwise(F.col("sample_id")))
    sites = _merged(cohorts, collapse).select("chrom", "pos", "kind", "alts", F.explode("x").alias("v")).select("chrom", "pos", "kind", "v.src", "v.site_id", F.transform("v.alts", lambda a: F.array_position("alts", a).cast("int")).alias("number"))
    calls = reduce(DataFrame.unionByName, [c.calls.select("site_id", "sample_id", "a1", "a2", "ploidy", "phased", "included").withColumn("src", F.lit(i)) for i, c in enumerate(cohorts, 1)])
    new = lambda a: F.when(F.col("included"), F.when(F.col(a) == 0, 0).otherwise(F.get("number", F.col(a) - 1))).alias(a)
    rows = calls.join(sites, ["src", "site_id"]).join(names, ["src", "sample_id"])
    return rows.select("chrom", "pos", "kind", F.col("name").alias("sample_id"), new("a1"), new("a2"), "ploidy", "phased")


def merge_records(cohorts: list[Cohort], collapse: str = "any") -> DataFrame:
    """``merge`` with AN and AC over all inputs, and the genotypes that are known as name=numbers in order of the names."""
    calls = merge_calls(cohorts, collapse)
    text = lambda a: F.coalesce(F.col(a).cast("string"), F.lit("."))
    gt = F.when(F.col("ploidy") == 1, text("a1")).otherwise(F.concat(text("a1"), F.when(F.col("phased"), "|").otherwise("/"), text("a2")))
    known = F.col("a1").isNotNull() | F.col("a2").isNotNull()
    per = calls.groupBy("chrom", "pos", "kind").agg(F.array_sort(F.collect_list(F.when(known, F.concat_ws("=", "sample_id", gt)))).alias("g"), F.flatten(F.collect_list(F.array_compact(F.array("a1", "a2")))).alias("all"))
    rows = _records(cohorts, collapse).join(per, ["chrom", "pos", "kind"], "left")
    n_alts = F.when(F.col("alt") == "", 0).otherwise(F.size(F.split("alt", ",")))
    counts = F.when(n_alts > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n_alts, F.lit(1))), lambda i: F.size(F.filter("all", lambda a: a == i)).cast("string")), ",")).otherwise("")
    return rows.select("chrom", "pos", "ref", "alt", "info", F.coalesce(F.size("all"), F.lit(0)).alias("an"), F.coalesce(counts, F.lit("")).alias("ac"), F.coalesce(F.array_join("g", " "), F.lit("")).alias("genotypes"))


def genotype_agreement(one: Cohort, two: Cohort) -> DataFrame:
    """Calls of shared samples at shared sites by kind of the first cohort's genotype: how many match, mismatch, are lost."""
    from locusframe.operators.compare import _both_called, _same, _shared_calls

    rows = _shared_calls(one, two).filter("x1 is not null and y1 is not null")
    kind = F.when((F.col("i1") == 0) & (F.col("j1") == 0), "hom_RR").when((F.col("i1") == 0) | (F.col("j1") == 0), "het_RA").when(F.col("i1") == F.col("j1"), "hom_AA").otherwise("het_AA")
    return rows.groupBy(kind.alias("kind")).agg(F.count_if(_both_called() & _same()).alias("n_match"), F.count_if(_both_called() & ~_same()).alias("n_mismatch"), F.count_if(~_both_called()).alias("n_lost"))
