"""Comparisons of two cohorts: outer joins by position and sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.alleles import allele, ratio
from locusframe.operators.stretches import running, runs
from locusframe.schema import Cohort


def sites(one: Cohort, two: Cohort) -> DataFrame:
    """files: B in both, 1 or 2 in one, O same position but another REF."""
    a = one.sites.select("chrom", "pos", F.col("ref").alias("ref_1"), F.array_join("alt", ",").alias("alt_1"))
    b = two.sites.select("chrom", "pos", F.col("ref").alias("ref_2"), F.array_join("alt", ",").alias("alt_2"))
    kind = F.when(F.col("ref_2").isNull(), "1").when(F.col("ref_1").isNull(), "2").when(F.col("ref_1") == F.col("ref_2"), "B").otherwise("O")
    return a.join(b, ["chrom", "pos"], "full").select("chrom", "pos", kind.alias("files"), "ref_1", "ref_2", "alt_1", "alt_2")


def overlapping_sites(one: Cohort, two: Cohort) -> DataFrame:
    """As ``sites``, with spans: of two records at different positions, one of each cohort, that share bases of their REFs, files is
    O as well.  Records are paired greedily, from the left: the next ones of both cohorts, or the one that lies before and
    does not reach the other.  A REF of N or '.' agrees with any.

    Records whose spans touch no other's are by themselves; the others are walked run by run."""
    rows = [c.sites.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), F.lit(k).alias("src"), "line_no") for k, c in ((1, one), (2, two))]
    grouped = runs(rows[0].unionByName(rows[1]), ["chrom"], F.col("pos") + F.greatest(F.length("ref"), F.lit(1)), ["src", "line_no"])
    each = F.array_sort(F.collect_list(F.struct("pos", "line_no", "ref", "alt", "src")))
    run = grouped.groupBy("chrom", "run").agg(each.alias("all"))
    run = run.withColumns({f"r{k}": F.filter("all", lambda x: x["src"] == k) for k in (1, 2)})  # noqa: B023
    none = F.lit(None).cast(run.schema["all"].dataType.elementType)
    unknown = lambda r: r.isin("N", ".", "")

    def step(acc: Column, _: Column) -> Column:
        a, b = F.get("r1", acc["i"]), F.get("r2", acc["j"])
        over = lambda x, y: y["pos"] < x["pos"] + F.length(x["ref"])
        both = F.when(a.isNull() | b.isNull(), False).when(a["pos"] == b["pos"], True).when(a["pos"] < b["pos"], over(a, b)).otherwise(over(b, a))
        left = a.isNotNull() & (both | b.isNull() | (a["pos"] < b["pos"]))
        right = b.isNotNull() & (both | a.isNull() | (b["pos"] < a["pos"]))
        same = (a["pos"] == b["pos"]) & ((a["ref"] == b["ref"]) | unknown(a["ref"]) | unknown(b["ref"]))
        kind = F.when(both, F.when(same, "B").otherwise("O")).when(left, "1").otherwise("2")
        made = F.struct(kind.alias("files"), F.when(left, a).otherwise(none).alias("a"), F.when(right, b).otherwise(none).alias("b"))
        return F.struct((acc["i"] + left.cast("int")).alias("i"), (acc["j"] + right.cast("int")).alias("j"), F.when(left | right, F.array_append(acc["out"], made)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.slice(F.array(F.struct(F.lit("").alias("files"), none.alias("a"), none.alias("b"))), 1, 0).alias("out"))
    made = run.select("chrom", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("o"))
    return made.select("chrom", F.col("o.a.pos").alias("pos_1"), F.col("o.b.pos").alias("pos_2"), "o.files", F.col("o.a.ref").alias("ref_1"), F.col("o.b.ref").alias("ref_2"), F.col("o.a.alt").alias("alt_1"), F.col("o.b.alt").alias("alt_2"))


def samples(one: Cohort, two: Cohort, names: DataFrame | None = None) -> DataFrame:
    """names: (id_1, id_2), the second cohort's names in terms of the first."""
    b = two.samples.select(F.col("sample_id").alias("id_2"))
    if names is not None:
        b = b.join(names, "id_2", "left").select(F.coalesce("id_1", "id_2").alias("id_2"))
    both = one.samples.select(F.col("sample_id").alias("id_1")).join(b, F.col("id_1") == F.col("id_2"), "full")
    return both.select(F.coalesce("id_1", "id_2").alias("sample_id"), F.when(F.col("id_2").isNull(), "1").when(F.col("id_1").isNull(), "2").otherwise("B").alias("files"))


def _shared_calls(one: Cohort, two: Cohort) -> DataFrame:
    """Calls of shared samples at sites with the same position and REF, alleles as text."""
    def text(c: Cohort, k: int) -> DataFrame:
        a = lambda x: F.when(F.col("included") & F.col(x).isNotNull(), allele(F.col(x)))
        return c.calls.join(c.sites.select("site_id", "chrom", "pos", "ref", "alt"), "site_id").select(
            "chrom", "pos", "ref", "sample_id", F.array_join("alt", ",").alias(f"alts_{k}"), a("a1").alias(f"x{k}"), a("a2").alias(f"y{k}"), F.col("a1").alias(f"i{k}"), F.col("a2").alias(f"j{k}"), F.col("phased").alias(f"phased_{k}"))
    return text(one, 1).join(text(two, 2), ["chrom", "pos", "ref", "sample_id"])


def _same():
    return (F.least("x1", "y1") == F.least("x2", "y2")) & (F.greatest("x1", "y1") == F.greatest("x2", "y2"))


def _both_called():
    return F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()


def discordance_by_sample(one: Cohort, two: Cohort) -> DataFrame:
    per = _shared_calls(one, two).groupBy("sample_id").agg(F.count_if(_both_called()).alias("n_common_called"), F.count_if(_both_called() & ~_same()).alias("n_discord"))
    return per.withColumn("discordance", ratio(F.col("n_discord"), F.col("n_common_called")))


def discordance_by_site(one: Cohort, two: Cohort) -> DataFrame:
    both = _shared_calls(one, two)
    per = both.groupBy("chrom", "pos").agg(F.count_if(_both_called()).alias("n_common_called"), F.count_if(_both_called() & ~_same()).alias("n_discord"), F.first(F.col("alts_1") == F.col("alts_2")).alias("matching_alleles"))
    files = sites(one, two).select("chrom", "pos", "files")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(per, ["chrom", "pos"], "left").select("chrom", "pos", "files", F.coalesce("matching_alleles", F.lit(False)).alias("matching_alleles"), zero("n_common_called"), zero("n_discord"), ratio(F.col("n_discord"), F.col("n_common_called")).alias("discordance"))


def discordance_matrix(one: Cohort, two: Cohort) -> DataFrame:
    """Counts of genotype pairs 0/0, 0/1, 1/1 and missing at biallelic sites with the same ALT; half-missing calls are
    left out."""
    def genotype(k: int):
        x, y = F.col(f"x{k}"), F.col(f"y{k}")
        i, j = F.col(f"i{k}"), F.col(f"j{k}")
        return F.when(x.isNull() & y.isNull(), "./.").when(x.isNotNull() & y.isNotNull(), F.concat_ws("/", F.least(i, j), F.greatest(i, j))).alias(f"gt_{k}")
    rows = _shared_calls(one, two).filter((F.col("alts_1") == F.col("alts_2")) & (F.length("alts_1") > 0) & ~F.col("alts_1").contains(","))
    return rows.select(genotype(1), genotype(2)).filter("gt_1 is not null and gt_2 is not null").groupBy("gt_1", "gt_2").agg(F.count("*").alias("n"))


def _phased_hets(one: Cohort, two: Cohort) -> DataFrame:
    """Heterozygous calls of shared samples that both cohorts phase and agree in: same, whether the phase does too, and last,
    the call of the sample's chromosome before it (pos, same)."""
    rows = _shared_calls(one, two).filter(_both_called() & _same() & F.col("phased_1") & F.col("phased_2") & (F.col("x1") != F.col("y1")))
    rows = rows.withColumn("same", F.col("x1") == F.col("x2"))
    return running(rows, ["sample_id", "chrom"], ["ref"], {"last": (F.struct("pos", "same"), "max")}, before_only=True)


def switch_errors(one: Cohort, two: Cohort) -> DataFrame:
    """Where the phase of a sample's heterozygous calls changes relative to the other cohort, on one chromosome: the
    interval from the last matching call."""
    rows = _phased_hets(one, two).filter(F.col("last.same") != F.col("same"))
    return rows.select("chrom", F.col("last.pos").alias("start"), F.col("pos").alias("end"), "sample_id")


def switch_summary(one: Cohort, two: Cohort) -> DataFrame:
    """A row a shared sample: heterozygous calls that both phase, switches between them, and their ratio (0 without any)."""
    per = _phased_hets(one, two).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_het"), F.count_if(F.col("last.same") != F.col("same")).alias("n_switch"))
    shared = one.samples.select("sample_id").join(two.samples.select("sample_id"), "sample_id")
    out = shared.join(per, "sample_id", "left").select("sample_id", F.coalesce("n_het", F.lit(0)).alias("n_het"), F.coalesce("n_switch", F.lit(0)).alias("n_switch"))
    return out.withColumn("rate", F.coalesce(ratio(F.col("n_switch"), F.col("n_het")), F.lit(0.0)))
