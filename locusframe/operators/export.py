"""Conversions to the text rows of other tools: DataFrames of lines or columns, to be written by any sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.alleles import allele, alleles, decode_genotype, gt_text, n_alleles
from locusframe.operators.counts import biallelic
from locusframe.operators.records import info_text
from locusframe.schema import Cohort


def in_order(value: Column, *order: str, by: str = " ") -> Column:
    """The values of a group joined by ``by`` in the order of the columns ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), by)


def _named(cohort: Cohort) -> DataFrame:
    return cohort.calls.join(cohort.samples, "sample_id")


def _call_text() -> Column:
    """A call under its site's FORMAT: GT as it stands now, the other fields as read, or GQ and DP where there are none."""
    number = lambda c: c.cast("string")
    known = lambda k: F.when(F.col("fmt").isNotNull(), F.element_at("fmt", k)).when(k == "GQ", number(F.col("gq").cast("int"))).when(k == "DP", number(F.col("dp")))
    return F.array_join(F.transform("format", lambda k: F.when(k == "GT", gt_text()).otherwise(F.coalesce(known(k), F.lit(".")))), ":")


def recoded(cohort: Cohort, info: list[str] | None = None, all_info: bool = False) -> DataFrame:
    """A row a site: site_id, its columns as text, FORMAT and the sample columns as one text joined by tabs (null for a
    site without calls).  INFO is dropped unless named."""
    per = _named(cohort).join(cohort.sites.select("site_id", "format"), "site_id").groupBy("site_id").agg(in_order(_call_text(), "sample_idx", by="\t").alias("calls"))
    kept = F.col("info") if all_info else F.map_filter("info", lambda k, v: k.isin(*(info or [""])))
    return cohort.sites.join(per, "site_id", "left").select(
        "site_id", "chrom", "pos", F.coalesce("id", F.lit(".")).alias("id"), "ref", F.when(F.size("alt") == 0, ".").otherwise(F.array_join("alt", ",")).alias("alt"), F.coalesce(F.col("qual").cast("string"), F.lit(".")).alias("qual"),
        F.when(F.size("filter") == 0, ".").otherwise(F.array_join("filter", ";")).alias("filter"), info_text(kept).alias("info"), F.when(F.col("calls").isNotNull(), F.array_join("format", ":")).alias("format"), "calls",
    )


def recode(cohort: Cohort, info: list[str] | None = None, all_info: bool = False) -> DataFrame:
    """A row a site as text, see ``recoded``."""
    return recoded(cohort, info, all_info).drop("site_id")


def _bases(missing: str = "0") -> Column:
    base = lambda i: F.when(F.col("included") & i.isNotNull(), allele(i)).otherwise(missing)
    second = F.when(F.col("ploidy") == 1, F.col("a1")).otherwise(F.col("a2"))
    return F.concat_ws(" ", base(F.col("a1")), base(second))


def plink_map(cohort: Cohort, names: dict[str, str] | None = None) -> DataFrame:
    """chrom number, id, genetic distance, position of sites with at most two alleles."""
    plain = F.regexp_extract("chrom", r"^(?:chr)?(\d+|X|Y|XY|MT|M)$", 1)
    number = F.when(plain == "", "0").otherwise(plain)
    for old, new in (names or {}).items():
        number = F.when(F.col("chrom") == old, new).otherwise(number)
    return cohort.sites.filter(n_alleles() <= 2).select("site_id", number.alias("chrom"), F.coalesce("id", F.concat_ws(":", "chrom", "pos")).alias("id"), F.lit(0).alias("cm"), "pos")


def plink_tped(cohort: Cohort) -> DataFrame:
    calls = _named(cohort).join(cohort.sites.filter(n_alleles() <= 2).select("site_id", "ref", "alt"), "site_id")
    per = calls.groupBy("site_id").agg(in_order(_bases(), "sample_idx").alias("genotypes"))
    return plink_map(cohort).join(per, "site_id").select("chrom", "id", "cm", "pos", "genotypes")


def plink_ped(cohort: Cohort) -> DataFrame:
    """A row a sample with its genotypes in the order of the sites."""
    calls = _named(cohort).join(cohort.sites.filter(n_alleles() <= 2).select("site_id", "line_no", "ref", "alt"), "site_id")
    return calls.groupBy("sample_id").agg(in_order(_bases(), "line_no").alias("genotypes"))


def matrix_012(cohort: Cohort) -> DataFrame:
    """A row a sample: 0 homozygous REF, 2 homozygous ALT, -1 missing, 1 else; biallelic sites."""
    code = F.when(~F.col("included") | (F.col("a1").isNull() & F.col("a2").isNull()), -1).when((F.col("a1") == 0) & (F.coalesce("a2", F.lit(0)) == 0) & ((F.col("ploidy") == 1) | F.col("a2").isNotNull()), 0).when((F.col("a1") == 1) & ((F.col("a2") == 1) | (F.col("ploidy") == 1)), 2).otherwise(1)
    calls = _named(cohort).join(cohort.sites.filter(n_alleles() == 2).select("site_id", "line_no"), "site_id")
    return calls.groupBy("sample_id").agg(in_order(code.cast("string"), "line_no", by="\t").alias("genotypes"))


def _complete_phased(cohort: Cohort) -> DataFrame:
    """Biallelic sites all of whose calls are phased and known."""
    per = cohort.calls.groupBy("site_id").agg(F.bool_and(F.col("included") & F.col("phased") & F.col("a1").isNotNull() & F.col("a2").isNotNull()).alias("ok")).filter("ok")
    return cohort.sites.filter(n_alleles() == 2).join(per, "site_id", "left_semi")


def impute(cohort: Cohort) -> DataFrame:
    """Legend and haplotypes: id, position, both alleles, and 0 or 1 for every chromosome copy."""
    s = _complete_phased(cohort)
    calls = _named(cohort).join(s.select("site_id"), "site_id", "left_semi")
    per = calls.groupBy("site_id").agg(in_order(F.concat_ws(" ", "a1", "a2"), "sample_idx").alias("haplotypes"))
    return s.join(per, "site_id").select(F.coalesce("id", F.concat_ws(":", "chrom", "pos")).alias("id"), "pos", F.col("ref").alias("allele0"), F.get("alt", F.lit(0)).alias("allele1"), "haplotypes")


def haplotype_strings(cohort: Cohort, chrom: str, bases: bool = False) -> DataFrame:
    """(sample_id, copy, sequence) of phased biallelic sites of ``chrom``: 0, 1 and ?, or bases and N."""
    s = biallelic(cohort).filter((F.col("chrom") == chrom) & F.col("all_phased")).select("site_id", "line_no", "ref", "alt")
    copies = F.explode(F.array(F.struct(F.lit(1).alias("copy"), F.col("a1").alias("a")), F.struct(F.lit(2).alias("copy"), F.col("a2").alias("a")))).alias("c")
    rows = cohort.calls.select("site_id", "sample_id", "included", copies).join(s, "site_id")
    known = F.col("included") & F.col("c.a").isNotNull()
    shown = F.when(known, allele(F.col("c.a"))).otherwise("N") if bases else F.when(known, F.col("c.a").cast("string")).otherwise("?")
    return rows.groupBy("sample_id", "c.copy").agg(in_order(shown, "line_no", by="").alias("sequence"))


def genotype_strings(cohort: Cohort, chrom: str) -> DataFrame:
    """(sample_id, sequence): 0 homozygous REF, 1 homozygous ALT, 2 heterozygous, ? unknown; biallelic diploid sites."""
    s = biallelic(cohort).filter(F.col("chrom") == chrom).select("site_id", "line_no")
    code = F.when(~F.col("included") | F.col("a1").isNull() | F.col("a2").isNull(), "?").when(F.col("a1") != F.col("a2"), "2").when(F.col("a1") == 0, "0").otherwise("1")
    return cohort.calls.join(s, "site_id").groupBy("sample_id").agg(in_order(code, "line_no", by="").alias("sequence"))


def loci(cohort: Cohort, chrom: str) -> DataFrame:
    """Positions in kilobases to three places."""
    return biallelic(cohort).filter((F.col("chrom") == chrom) & F.col("all_phased")).select("pos", F.format_string("%.4f", F.col("pos") / 1000).alias("kb"))


def get_info(cohort: Cohort, keys: list[str]) -> DataFrame:
    return cohort.sites.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), *[F.coalesce(F.col("info")[k], F.lit("?")).alias(k) for k in keys])


def format_field(cohort: Cohort, field: Column, samples: list[str]) -> DataFrame:
    """A column of ``field`` a named sample; sites where no sample has it are left out."""
    wide = cohort.calls.withColumn("_f", field).filter("_f is not null").groupBy("site_id").pivot("sample_id", samples).agg(F.first("_f"))
    return cohort.sites.select("site_id", "chrom", "pos").join(wide, "site_id").drop("site_id")


def likelihoods(cohort: Cohort, field: str) -> DataFrame:
    """(chrom, pos, sample_id, l0, l1, l2) from FORMAT GL (log10) or PL (phred) of biallelic sites; masked calls 1 1 1."""
    s = cohort.sites.filter(n_alleles() == 2).select("site_id", "chrom", "pos")
    parts = F.split(F.col("fmt")[field], ",")
    power = lambda i: F.pow(F.lit(10.0), F.get(parts, F.lit(i)).try_cast("double") / (1.0 if field == "GL" else -10.0))
    value = lambda i: F.when(F.col("included"), F.coalesce(power(i), F.lit(1.0))).otherwise(1.0).alias(f"l{i}")
    return cohort.calls.join(s, "site_id").select("chrom", "pos", "sample_id", value(0), value(1), value(2))


IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def to_tab(cohort: Cohort, iupac: bool = False) -> DataFrame:
    """chrom, pos, ref and the calls of all samples as bases, or as one ambiguity code."""
    shown = decode_genotype()
    if iupac:
        a, b = allele(F.col("a1")), allele(F.col("a2"))
        code = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])[F.concat(F.least(a, b), F.greatest(a, b))]
        shown = F.when(F.col("a1").isNull() | F.col("a2").isNull(), ".").when(F.col("a1") == F.col("a2"), a).otherwise(F.coalesce(code, shown))
    calls = _named(cohort).join(cohort.sites.select("site_id", "ref", "alt"), "site_id")
    per = calls.groupBy("site_id").agg(in_order(shown, "sample_idx", by="\t").alias("calls"))
    return cohort.sites.select("site_id", "chrom", "pos", "ref").join(per, "site_id").drop("site_id")


def template(cohort: Cohort, text: str) -> DataFrame:
    """Lines from a template: %CHROM %POS %ID %REF %ALT %QUAL %FILTER %INFO (all of it), %INFO/KEY, %INFO/KEY[i] (item i of a
    list, from 0) and %LINE (the record as text); and in brackets, for every sample, %SAMPLE, %GT (bases), %GTR (numbers), and
    any FORMAT key, %KEY[i] for an item of it; \\t and \\n stand for tab and line end.  What is missing is '.'."""
    import re

    of_site = {"CHROM": F.col("chrom"), "POS": F.col("pos").cast("string"), "ID": F.coalesce("id", F.lit(".")), "REF": F.col("ref"), "ALT": F.when(F.size("alt") == 0, ".").otherwise(F.array_join("alt", ",")), "QUAL": F.coalesce(F.col("qual").cast("string"), F.lit(".")), "FILTER": F.when(F.size("filter") == 0, ".").otherwise(F.array_join("filter", ";")), "INFO": info_text(F.col("info")), "LINE": F.col("_line")}
    of_call = {"SAMPLE": F.col("sample_id"), "GT": decode_genotype(), "GTR": gt_text()}
    known = {"GQ": F.col("gq").cast("int").cast("string"), "DP": F.col("dp").cast("string")}
    item = lambda value, i: F.coalesce(value if i == "" else F.get(F.split(value, ","), F.lit(int(i))), F.lit("."))

    def field(name: str) -> Column:
        own = F.element_at("fmt", name)
        return F.coalesce(own, known[name]) if name in known else own

    def parts(t: str, names: dict[str, Column], call: bool) -> list[Column]:
        out = []
        for literal, key, i, name, j in re.findall(r"([^%]+?(?=%|$))|%INFO/(\w+)(?:\{(\d+)\})?|%(\w+)(?:\{(\d+)\})?", t):
            if literal:
                out.append(F.lit(literal.replace("\\t", "\t").replace("\\n", "\n")))
            elif key:
                out.append(item(F.element_at("info", key), i))
            else:
                out.append(names[name] if name in names and not j else item(field(name) if call else names[name], j))
        return out

    # items are marked by braces within, as brackets mark what is repeated
    pieces = re.split(r"\[(.*?)\]", re.sub(r"(%(?:INFO/)?\w+)\[(\d+)\]", r"\1{\2}", text))
    rows, loops = cohort.sites, []
    if "%LINE" in text:
        whole = recoded(cohort, all_info=True)
        rows = rows.join(whole.select("site_id", F.concat_ws("\t", *[c for c in whole.columns if c != "site_id"]).alias("_line")), "site_id")
    calls = _named(cohort).join(cohort.sites.select("site_id", "ref", "alt", "info"), "site_id")
    for i, loop in enumerate(pieces[1::2]):
        loops.append(calls.groupBy("site_id").agg(in_order(F.concat(*parts(loop, of_call, True)), "sample_idx", by="").alias(f"_loop{i}")))
    for x in loops:
        rows = rows.join(x, "site_id")
    line = []
    for i, piece in enumerate(pieces):
        line += parts(piece, of_site, False) if i % 2 == 0 else [F.col(f"_loop{i // 2}")]
    return rows.select("chrom", "pos", F.concat(*line).alias("line"))
