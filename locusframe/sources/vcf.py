"""Variant text files as cohorts and back.  Lines are split by column expressions, so unused columns are pruned."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.schema import CALLS, SAMPLES, Cohort, Field


def parse_header(lines: list[str]) -> tuple[list[Field], list[str]]:
    """(declared fields, sample names) from the lines that start with #."""
    fields, samples = [], []
    for line in lines:
        if m := re.match(r"##(INFO|FORMAT|FILTER|contig)=<(.*)>", line):
            own = dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2]))
            fields.append(Field(m[1], own.get("ID", ""), own.get("Number", "1"), own.get("Type", "String"), own.get("Description", "").strip('"')))
        elif line.startswith("#CHROM"):
            samples = line.rstrip("\n").split("\t")[9:]
    return fields, samples


def header_lines(text: DataFrame) -> list[str]:
    """The lines at the start of ``text`` that start with #: no more of it is read than they need, and one row."""
    n = 1000
    while True:
        head = [r["value"] for r in text.take(n)]
        own = next((i for i, line in enumerate(head) if not line.startswith("#")), len(head))
        if own < len(head) or len(head) < n:
            return head[:own]
        n *= 10


def read(spark: SparkSession, path: str) -> Cohort:
    """A file or folder of text (plain or .gz), folders within it too.  The header stands at the start of the first file,
    by name, that has any; files of one folder must share it."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    header = next((h for f in sorted(text.inputFiles()) if (h := header_lines(spark.read.text(f)))), [])
    if not any(line.startswith("#CHROM") for line in header):
        raise ValueError(f"no #CHROM line at the start of {path}")
    fields, samples = parse_header(header)
    lines = text.filter(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    return parse(spark, lines, header, fields, samples)


def parse(spark: SparkSession, lines: DataFrame, header: list[str], fields: list[Field], samples: list[str]) -> Cohort:
    """lines: (value).  A line's number is its place in the file order that the scan gives."""
    numbered = lines.withColumn("line_no", F.monotonically_increasing_id()).withColumn("c", F.split(F.rtrim("value"), "\t"))
    at = lambda i: F.get("c", F.lit(i))
    or_null = lambda x: F.when(x != ".", x)
    empty = F.array().cast("array<string>")
    listed = lambda x, by: F.when(x == ".", empty).otherwise(F.split(x, by))
    pairs = F.transform(F.filter(F.split(at(7), ";"), lambda kv: (kv != "") & (kv != ".")), lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), F.when(F.contains(kv, F.lit("=")), F.substr(kv, F.instr(kv, "=") + 1)).otherwise("1").alias("v")))
    first = F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1))
    sites = numbered.select(
        F.col("line_no").alias("site_id"), at(0).alias("chrom"), F.coalesce(at(1).try_cast("int"), F.lit(0)).alias("pos"), or_null(at(2)).alias("id"), F.upper(at(3)).alias("ref"),
        F.transform(listed(at(4), ","), F.upper).alias("alt"), at(5).try_cast("double").alias("qual"), F.array_sort(listed(at(6), ";")).alias("filter"), first.alias("info"), at(7).alias("info_raw"),
        F.coalesce(F.split(at(8), ":"), empty).alias("format"), "line_no",
    )
    names = F.array(*[F.lit(s) for s in samples]) if samples else empty
    each = numbered.select(F.col("line_no").alias("site_id"), F.split(at(8), ":").alias("format"), F.posexplode(F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0)))).alias("i", "text"))
    values = F.split("text", ":")
    entries = F.filter(F.transform("format", lambda k, i: F.struct(k.alias("k"), F.get(values, i).alias("v"))), lambda e, i: F.array_position("format", e["k"]) == i + 1)  # the first of a repeated key
    each = each.select("site_id", F.get(names, F.col("i")).alias("sample_id"), F.map_from_entries(entries).alias("fmt"))
    gt = F.coalesce(F.col("fmt")["GT"], F.lit("./."))
    parts = F.split(gt, r"[/|]")
    haploid, gq = F.size(parts) == 1, F.col("fmt")["GQ"].try_cast("double")
    calls = each.select(
        "site_id", "sample_id", F.get(parts, F.lit(0)).try_cast("int").alias("a1"), F.get(parts, F.lit(1)).try_cast("int").alias("a2"), F.when(haploid, 1).otherwise(2).cast("tinyint").alias("ploidy"),
        (haploid | F.contains(gt, F.lit("|"))).alias("phased"), F.when(gq > 99, 99.0).otherwise(gq).alias("gq"), F.col("fmt")["DP"].try_cast("int").alias("dp"),
        F.when(F.coalesce(F.col("fmt")["FT"], F.lit(".")).isin(".", ""), empty).otherwise(F.split(F.col("fmt")["FT"], ";")).alias("ft"), "fmt", F.lit(True).alias("included"),
    )
    return Cohort(sites, calls, spark.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample_id string, sample_idx int"), header, fields)


def from_positions(positions: DataFrame) -> Cohort:
    """positions: (chrom, pos), as of a tab-separated list.  Sites without alleles, for the operators on several inputs."""
    sites = positions.select(F.monotonically_increasing_id().alias("site_id"), "chrom", "pos", F.lit(None).cast("string").alias("id"), F.lit("N").alias("ref"), F.array().cast("array<string>").alias("alt"), F.lit(None).cast("double").alias("qual"))
    sites = sites.withColumns({"filter": F.array().cast("array<string>"), "info": F.create_map().cast("map<string,string>"), "info_raw": F.lit("."), "format": F.array().cast("array<string>"), "line_no": F.col("site_id")})
    spark = positions.sparkSession
    return Cohort(sites, spark.createDataFrame([], CALLS), spark.createDataFrame([], SAMPLES))


def from_tab(rows: DataFrame, samples: list[str]) -> DataFrame:
    """rows: chrom, pos, ref, calls (genotypes as bases, joined by tabs in the order of ``samples``).  A row a site as text:
    chrom, pos, ref, alt (in the order in which the calls name them), format and calls."""
    each = F.split("calls", "\t")
    bases = lambda c: F.split(c, r"[/|]")
    alts = F.array_distinct(F.filter(F.flatten(F.transform(each, bases)), lambda b: (b != ".") & (b != F.col("ref"))))
    rows = rows.withColumn("alts", alts)
    number = lambda b: F.when(b == ".", ".").when(b == F.col("ref"), "0").otherwise(F.array_position("alts", b).cast("string"))
    numbers = lambda c: F.transform(bases(c), number)
    gt = F.transform(each, lambda c: F.when(c.contains("|"), F.array_join(numbers(c), "|")).otherwise(F.array_join(numbers(c), "/")))
    return rows.filter(F.size(each) == len(samples)).select("chrom", "pos", "ref", F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ",")).alias("alt"), F.lit("GT").alias("format"), F.array_join(gt, "\t").alias("calls"))


def lines(cohort: Cohort, all_info: bool = True, numbered: bool = False) -> DataFrame:
    """(value): the records as text lines, in the order of chromosome and line.  ``numbered``: unordered, with site_id, chrom,
    pos and line_no."""
    from locusframe.operators.export import recoded

    rows = recoded(cohort, all_info=all_info).join(cohort.sites.select("site_id", "line_no"), "site_id")
    value = F.concat_ws("\t", "chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "calls").alias("value")
    return rows.select("site_id", "chrom", "pos", "line_no", value) if numbered else rows.orderBy("line_no").select(value)


def head(cohort: Cohort) -> list[str]:
    """The header's lines, the columns' line last."""
    lines_ = [h for h in cohort.header if h.startswith("##")] or ["##fileformat=VCFv4.2"]
    names = [r["sample_id"] for r in cohort.samples.orderBy("sample_idx").collect()]
    return [*lines_, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *names] if names else [])])]


def write(cohort: Cohort, path: str, all_info: bool = True) -> None:
    """A folder of text parts; the header is a part of its own that sorts first."""
    spark = cohort.sites.sparkSession
    spark.createDataFrame([(h,) for h in head(cohort)], "value string").coalesce(1).write.mode("append").text(f"{path}/header")
    lines(cohort, all_info).write.mode("append").text(f"{path}/records")
