"""Operators with a reference sequence, kept as chunks (chrom, start, seq): seq holds bases start .. start + length - 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.alleles import allele
from locusframe.operators.stretches import running, runs
from locusframe.schema import Cohort


def _sized(reference: DataFrame) -> int:
    return reference.select(F.max(F.length("seq"))).first()[0] or 1


def bases_at(sites: DataFrame, reference: DataFrame, before: int = 0, after: int | Column = 0) -> DataFrame:
    """Adds ``bases``: the reference from pos - before to pos + after, N outside it.  Chunks start at 1 + k * size, so a
    stretch is put together from the chunks it meets by an equality join."""
    size = _sized(reference)
    after = after if isinstance(after, Column) else F.lit(after)
    chunk = reference.withColumn("_c", F.floor((F.col("start") - 1) / size)).select("chrom", "_c", "start", "seq")
    laid = sites.select("site_id", "chrom", "pos", F.explode(F.sequence(F.floor((F.greatest(F.col("pos") - before, F.lit(1)) - 1) / size), F.floor((F.greatest(F.col("pos") + after, F.lit(1)) - 1) / size))).alias("_c"))
    got = laid.join(chunk, ["chrom", "_c"])
    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    per = got.groupBy("site_id").agg(parts.alias("p"))
    text, first = F.array_join(F.col("p.seq"), ""), F.get("p.start", F.lit(0))
    out = sites.join(per, "site_id", "left")
    left = F.greatest(F.lit(0), first - (F.col("pos") - before))
    cut = F.concat(F.repeat(F.lit("N"), left), F.substr(text, F.greatest(F.lit(1), F.col("pos") - before - first + 1), after + (before + 1) - left))
    return out.withColumn("bases", F.rpad(F.coalesce(cut, F.lit("")), after + (before + 1), F.lit("N"))).drop("p")


def ancestral(cohort: Cohort, reference: DataFrame) -> DataFrame:
    """INFO AA from an ancestral sequence."""
    return bases_at(cohort.sites, reference).select("chrom", "pos", F.upper("bases").alias("aa"))


def flanks(cohort: Cohort, reference: DataFrame, width: int) -> DataFrame:
    """The flanking sequence, with the site's alleles in brackets."""
    rows = bases_at(cohort.sites, reference, width, width)
    inner = F.concat(F.lit("["), "ref", F.lit("/"), F.array_join("alt", ","), F.lit("]"))
    return rows.select("chrom", "pos", F.concat(F.substr("bases", F.lit(1), F.lit(width)), inner, F.substr("bases", F.lit(width + 2), F.lit(width))).alias("flank"))


def mismatches(cohort: Cohort, reference: DataFrame) -> DataFrame:
    """Sites whose first REF base differs from the reference."""
    rows = bases_at(cohort.sites, reference)
    return rows.filter(F.upper("bases") != F.upper(F.substr("ref", F.lit(1), F.lit(1)))).select("chrom", "pos", "ref", "bases")


def digests(reference: DataFrame) -> DataFrame:
    """MD5 of each chromosome's upper-case sequence; its chunks, in order, are the input of one digest."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.upper("seq").alias("s")))), lambda x: x["s"]), "")
    return reference.groupBy("chrom").agg(F.md5(text.cast("binary")).alias("md5"), F.sum(F.length("seq")).alias("length"))


def _applied(variants: DataFrame, by: list[str]) -> DataFrame:
    """variants: (*by, pos, ref, new).  Those that don't start within an applied one before.  Overlapping ones are runs,
    found in order of position; each run is walked by itself."""
    variants = runs(variants.withColumn("end", F.col("pos") + F.length("ref")), by, F.col("end"), ["ref", "new"])
    one = F.struct("pos", "ref", "new", "end")

    def step(acc: Column, v: Column) -> Column:
        fits = v["pos"] >= acc["at"]
        return F.struct(F.when(fits, v["end"]).otherwise(acc["at"]).alias("at"), F.when(fits, F.array_append(acc["kept"], v)).otherwise(acc["kept"]).alias("kept"))

    grouped = variants.groupBy(*by, "run").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.slice("all", 1, 0).alias("kept")), step, lambda acc: acc["kept"])
    return grouped.select(*by, F.explode(kept).alias("v")).select(*by, "v.*")


def _edited(reference: DataFrame, variants: DataFrame, by: list[str]) -> DataFrame:
    """reference: (*by, start, seq); variants: (*by, pos, ref, new).  The chunks with the variants applied.  A variant that
    starts within an applied one is left out; one that crosses a chunk's end goes into the chunk in which it starts, and
    the next ones lose the bases that it replaces."""
    size = _sized(reference)
    chosen = _applied(variants.filter(F.col("new").rlike("^[ACGTNacgtn]+$")).select(*by, "pos", "ref", "new"), by)
    number = lambda x: F.floor((x - 1) / size)
    laid = chosen.select("*", F.explode(F.sequence(number(F.col("pos")), number(F.col("end") - 1))).alias("_c"))
    # places within the chunk, from 0
    first = F.greatest(F.col("pos") - 1 - F.col("_c") * size, F.lit(0)).cast("int")
    laid = laid.select(*by, "_c", first.alias("first"), (F.col("end") - 1 - F.col("_c") * size).cast("int").alias("past"), F.when(number(F.col("pos")) == F.col("_c"), F.col("new")).otherwise("").alias("new"))
    per = laid.groupBy(*by, "_c").agg(F.array_sort(F.collect_list(F.struct("first", "past", "new"))).alias("edits"))
    chunk = reference.withColumn("_c", number(F.col("start"))).select(*by, "_c", "start", "seq").join(per, [*by, "_c"], "left")
    # an edit past the end of the last chunk has no bases to replace
    edits = F.filter("edits", lambda e: e["first"] < F.length("seq"))
    piece = lambda acc, e: F.struct(F.concat(acc["out"], F.substr("seq", acc["at"] + 1, e["first"] - acc["at"]), e["new"]).alias("out"), e["past"].alias("at"))
    edited = F.aggregate(edits, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), piece, lambda acc: F.concat(acc["out"], F.substr("seq", acc["at"] + 1)))
    return chunk.select(*by, "start", F.coalesce(edited, "seq").alias("seq"))


def consensus(cohort: Cohort, reference: DataFrame, sample: str | None = None, copy: int = 1) -> DataFrame:
    """(chrom, start, seq): the chunks with the variants of a sample's chromosome copy (or, without one, the first ALTs)
    applied."""
    if sample is None:
        chosen = cohort.sites.filter(F.size("alt") > 0).withColumn("new", F.get("alt", F.lit(0)))
    else:
        a = F.col("a1") if copy == 1 else F.coalesce("a2", F.when(F.col("ploidy") == 1, F.col("a1")))
        mine = cohort.calls.filter((F.col("sample_id") == sample) & F.col("included")).select("site_id", a.alias("a")).filter("a > 0")
        chosen = cohort.sites.join(mine, "site_id").withColumn("new", allele(F.col("a")))
    return _edited(reference, chosen, ["chrom"])


def haplotypes(cohort: Cohort, reference: DataFrame) -> DataFrame:
    """(sample_id, copy, chrom, start, seq): both sequences of every sample from its phased calls, all chunks of each."""
    copies = F.explode(F.array(F.struct(F.lit(1).alias("copy"), F.col("a1").alias("a")), F.struct(F.lit(2).alias("copy"), F.coalesce("a2", F.when(F.col("ploidy") == 1, F.col("a1"))).alias("a")))).alias("c")
    calls = cohort.calls.filter("included and phased").select("site_id", "sample_id", copies).select("site_id", "sample_id", "c.*").filter("a > 0")
    chosen = cohort.sites.join(calls, "site_id").withColumn("new", allele(F.col("a")))
    every = F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")
    return _edited(reference.crossJoin(cohort.samples.select("sample_id", every)), chosen, ["sample_id", "copy", "chrom"])


def lifted(cohort: Cohort, features: DataFrame) -> DataFrame:
    """features: (chrom, start, end, ...), both inclusive.  (sample_id, copy, ...): where each feature lies on both sequences of
    every sample, as ``haplotypes`` makes them.

    A place moves by the sum of the length changes of the variants that end before it.  A deletion takes its bases behind
    those that ALT has: a feature that starts within starts behind it, one that ends within ends before it, and one that lies
    within is gone."""
    copies = F.explode(F.array(F.struct(F.lit(1).alias("copy"), F.col("a1").alias("a")), F.struct(F.lit(2).alias("copy"), F.coalesce("a2", F.when(F.col("ploidy") == 1, F.col("a1"))).alias("a")))).alias("c")
    calls = cohort.calls.filter("included and phased").select("site_id", "sample_id", copies).select("site_id", "sample_id", "c.*").filter("a > 0")
    by = ["sample_id", "copy", "chrom"]
    chosen = cohort.sites.join(calls, "site_id").withColumn("new", allele(F.col("a"))).filter(F.col("new").rlike("^[ACGTNacgtn]+$"))
    used = _applied(chosen.select(*by, "pos", "ref", "new"), by).withColumn("change", (F.length("new") - F.length("ref")).cast("long")).filter("change <> 0")
    hole = F.struct((F.col("pos") + F.length("new")).alias("from"), F.col("end").alias("until"))
    none = F.lit(None).cast(used.select(hole.alias("h")).schema["h"].dataType)
    numbered = features.withColumn("_id", F.monotonically_increasing_id())
    every = numbered.crossJoin(cohort.samples.select("sample_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")))  # the result's own rows
    marks = used.select(*by, F.explode(F.array(
        F.struct(F.col("end").cast("long").alias("pos"), F.col("change").alias("change"), none.alias("hole")), F.struct((F.col("pos") + F.length("new")).cast("long").alias("pos"), F.lit(0).cast("long").alias("change"), F.when(F.col("change") < 0, hole).alias("hole")),
    )).alias("m")).select(*by, "m.*", F.lit(None).cast("long").alias("_id"), F.lit(0).alias("_ask"))
    asked = every.select(*by, F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(1).alias("_ask")), F.struct(F.col("end").cast("long").alias("pos"), F.lit(2).alias("_ask")))).alias("m"), "_id")
    asked = asked.select(*by, "m.pos", F.lit(0).cast("long").alias("change"), none.alias("hole"), "_id", "m._ask")
    told = running(marks.unionByName(asked), by, ["_ask"], {"shift": (F.col("change"), "sum"), "last": (F.col("hole"), "max")}).filter("_ask > 0")
    within = F.coalesce(F.col("pos") < F.col("last.until"), F.lit(False))
    place = F.coalesce("shift", F.lit(0)) + F.when(within, F.col("last.from") - F.when(F.col("_ask") == 2, 1).otherwise(0)).otherwise(F.col("pos"))
    ends = told.groupBy(*by, "_id").agg(*[F.max(F.when(F.col("_ask") == k, v)).alias(n) for k, side in ((1, "start"), (2, "end")) for n, v in ((f"_{side}", place), (f"_hole_{side}", F.when(within, F.col("last.from"))))])
    gone = F.coalesce(F.col("_hole_start") == F.col("_hole_end"), F.lit(False))
    out = numbered.drop("start", "end", "chrom").join(ends.filter(~gone), "_id")
    rest = [c for c in features.columns if c not in ("chrom", "start", "end")]
    return out.select("sample_id", "copy", "chrom", F.col("_start").alias("start"), F.col("_end").alias("end"), *rest)
