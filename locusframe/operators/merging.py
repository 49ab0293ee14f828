"""Cohorts whose alleles are numbered anew: merged inputs and subsets, with every field that is listed by allele."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import n_alleles
from locusframe.functions.fields import numbers, reindexed, reindexed_map
from locusframe.operators.counts import called
from locusframe.operators.sets import ITEMS, SUMMED, _merged, numbered
from locusframe.schema import Cohort, Field


def renumbered(cohort: Cohort, table: DataFrame) -> Cohort:
    """table: (site_id, back), array<int> from 0 as in ``functions.fields``; sites that it lacks stay.  ALT, genotypes and the
    fields listed by allele or genotype follow; alleles that go are missing in calls."""
    info, fmt = numbers(cohort.fields, "INFO"), numbers(cohort.fields, "FORMAT")
    sites = cohort.sites.join(table, "site_id", "left").withColumn("_n", n_alleles())
    changed = F.col("back").isNotNull()
    kept = F.transform(F.slice("back", 2, F.size("back")), lambda b: F.get("alt", b - 1))
    new = sites.withColumn("info", F.when(changed, reindexed_map(F.col("info"), info, F.col("back"), F.col("_n"))).otherwise(F.col("info"))).withColumn("alt", F.when(changed, kept).otherwise(F.col("alt")))
    calls = cohort.calls.join(sites.filter(changed).select("site_id", "back", "_n"), "site_id", "left")
    number = lambda a: F.when(F.col("back").isNull(), F.col(a)).otherwise(F.nullif((F.array_position("back", F.col(a)) - 1).cast("int"), F.lit(-1)))
    calls = calls.withColumns({"a1": number("a1"), "a2": number("a2"), "fmt": F.when(F.col("back").isNotNull(), reindexed_map(F.col("fmt"), fmt, F.col("back"), F.col("_n"), F.col("ploidy") == 1)).otherwise(F.col("fmt"))})
    return cohort.with_(sites=new.drop("back", "_n"), calls=calls.drop("back", "_n"))


def filled_counts(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """``sites`` with INFO AN and AC as the calls say."""
    per = called(calls).groupBy("site_id", "allele").agg(F.count(F.lit(1)).alias("n")).groupBy("site_id").agg(F.sum("n").alias("_an"), F.map_from_entries(F.collect_list(F.struct("allele", "n"))).alias("_counts"))
    out = sites.join(per.hint("merge"), "site_id", "left")
    ac = F.transform("alt", lambda a, i: F.coalesce(F.element_at("_counts", i + 1), F.lit(0)).cast("string"))
    rest = F.map_filter("info", lambda k, v: ~k.isin("AN", "AC"))
    own = F.when(F.size("alt") > 0, F.create_map(F.lit("AN"), F.coalesce("_an", F.lit(0)).cast("string"), F.lit("AC"), F.array_join(ac, ","))).otherwise(F.create_map(F.lit("AN"), F.coalesce("_an", F.lit(0)).cast("string")))
    return out.withColumn("info", F.map_concat(rest, own)).drop("_an", "_counts")


def subset_cohort(cohort: Cohort, samples: DataFrame, trim: bool = True, private: bool = False) -> Cohort:
    """The cohort of ``samples`` alone, AN and AC counted anew.  ``trim``: ALTs that none of them has go, and lists by allele or
    genotype with them.  ``private``: only sites with an allele that no other sample has."""
    mine = samples.select("sample_id").distinct()
    rows = called(cohort.calls).filter("allele > 0").join(mine.withColumn("_mine", F.lit(True)), "sample_id", "left")
    per = rows.groupBy("site_id", "allele").agg(F.count_if("_mine").alias("own"), F.count_if(F.col("_mine").isNull()).alias("other")).filter("own > 0")
    sites = cohort.sites
    if private:
        sites = sites.join(per.filter("other = 0").select("site_id").distinct(), "site_id", "left_semi")
    order = cohort.samples.join(mine, "sample_id", "left_semi")
    order = order.withColumn("sample_idx", (F.row_number().over(Window.orderBy("sample_idx")) - 1).cast("int"))  # a row a sample
    out = cohort.with_(sites=sites, calls=cohort.calls.join(mine, "sample_id", "left_semi").join(sites.select("site_id"), "site_id", "left_semi"), samples=order)
    if trim:
        carried = per.groupBy("site_id").agg(F.sort_array(F.collect_set("allele")).alias("c"))
        back = sites.select("site_id").join(carried, "site_id", "left").select("site_id", F.concat(F.array(F.lit(0)), F.coalesce("c", F.array().cast("array<int>"))).alias("back"))
        out = renumbered(out, back)
    return out.with_(sites=filled_counts(out.sites, out.calls))


def _merged_info(kinds: dict[str, str]) -> Column:
    """INFO of the inputs x: sums and item-by-item sums; lists by allele from the first input that knows the allele; else the
    first input's value.  AN and AC are left to the caller."""
    listed = lambda v: F.transform(F.filter(v["info"], lambda e: ~e["key"].isin("AN", "AC")), lambda e: F.struct(e["key"].alias("key"), _one(e, v).alias("value")))

    def _one(e: Column, v: Column) -> Column:
        out = e["value"]
        for number in ("A", "R", "G"):
            if own := [k for k, n in kinds.items() if n == number]:
                out = F.when(e["key"].isin(*own), reindexed(e["value"], number, v["back"], F.size(v["alts"]) + 1)).otherwise(out)
        return out

    entries = F.flatten(F.transform("y", listed))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    lists = [k for k in kinds if k not in ("AN", "AC")]
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))

    def value(k: Column) -> Column:
        every = F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])
        split = lambda i: F.split(F.get(every, i), ",")
        rest = F.slice(every, 2, F.size(every))
        sums = F.aggregate(rest, F.transform(split(F.lit(0)), number), lambda acc, v: F.zip_with(acc, F.split(v, ","), lambda a, b: F.coalesce(a, F.lit(0)) + number(b)))
        known = F.aggregate(rest, split(F.lit(0)), lambda acc, v: F.zip_with(acc, F.split(v, ","), lambda a, b: F.when(a.isNull() | (a == "."), F.coalesce(b, F.lit("."))).otherwise(a)))
        out = F.when(k.isin(*SUMMED, *ITEMS), F.array_join(F.transform(sums, lambda n: n.cast("string")), ",")).otherwise(F.get(every, F.lit(0)))
        return F.when(k.isin(*lists), F.array_join(known, ",")).otherwise(out) if lists else out

    return F.map_from_arrays(keys, F.transform(keys, value))


def merged_cohort(cohorts: list[Cohort], collapse: str = "any") -> Cohort:
    """The full outer merge of ``sets.merge`` as a cohort: every sample of every input with every FORMAT field, lists by allele
    or genotype renumbered, calls of inputs without the record missing.

    INFO AN and AC are counted from the calls (summed over the inputs where none has samples), SF lists the inputs, with f
    where the record did not pass.  Of several records of one input that are alike, each goes into a record of its own.  ID is the first that is known, FORMAT the union with GT first.  Names that inputs share
    get the input's number as a prefix."""
    fields: dict[tuple[str, str], Field] = {}
    for c in cohorts:
        for f in c.fields:
            fields.setdefault((f.kind, f.id), f)
    declared = list(fields.values())
    info, fmt = numbers(declared, "INFO"), numbers(declared, "FORMAT")
    n = len(cohorts)
    back = lambda v: F.concat(F.array(F.lit(0)), F.transform("alts", lambda a: F.nullif(F.array_position(v["alts"], a).cast("int"), F.lit(0))))
    per = _merged(cohorts, collapse, apart=True).withColumn("y", F.transform("x", lambda v: v.withField("back", back(v))))
    per = per.withColumn("new_id", F.get("x", F.lit(0))["site_id"] * n + F.get("x", F.lit(0))["src"] - 1)

    names = reduce(DataFrame.unionByName, [c.samples.select("sample_id", "sample_idx").withColumn("src", F.lit(i)) for i, c in enumerate(cohorts, 1)])
    shared = F.count("*").over(Window.partitionBy("sample_id")) > 1
    names = names.withColumn("name", F.when(shared, F.concat_ws("_", "src", "sample_id")).otherwise(F.col("sample_id")))
    samples = names.select(F.col("name").alias("sample_id"), (F.row_number().over(Window.orderBy("src", "sample_idx")) - 1).cast("int").alias("sample_idx"))  # a row a sample

    where = per.select("new_id", F.explode("y").alias("v")).select("new_id", "v.src", "v.site_id", "v.back", (F.size("v.alts") + 1).alias("n_old"))
    calls = reduce(DataFrame.unionByName, [c.calls.withColumn("src", F.lit(i)) for i, c in enumerate(cohorts, 1)])
    # sites grow with the input, whatever their table's size in files makes Spark expect: the driver never gets them to broadcast
    calls = calls.join(where.hint("merge"), ["src", "site_id"]).join(F.broadcast(names.select("src", "sample_id", "name")), ["src", "sample_id"])
    number = lambda a: F.nullif((F.array_position("back", F.col(a)) - 1).cast("int"), F.lit(-1)).alias(a)
    own = F.map_filter("fmt", lambda k, v: k != "GT")
    calls = calls.select(
        F.col("new_id").alias("site_id"), F.col("name").alias("sample_id"), number("a1"), number("a2"), "ploidy", "phased", "gq", "dp", "ft", reindexed_map(own, fmt, F.col("back"), F.col("n_old"), F.col("ploidy") == 1).alias("fmt"), "included",
    )
    absent = per.select("new_id", F.explode(F.array_except(F.array(*[F.lit(i) for i in range(1, n + 1)]), F.transform("x", lambda v: v["src"]))).alias("src")).join(F.broadcast(names.select("src", "name")), "src")
    absent = absent.select(
        F.col("new_id").alias("site_id"), F.col("name").alias("sample_id"), F.lit(None).cast("int").alias("a1"), F.lit(None).cast("int").alias("a2"), F.lit(2).cast("tinyint").alias("ploidy"), F.lit(False).alias("phased"),
        F.lit(None).cast("double").alias("gq"), F.lit(None).cast("int").alias("dp"), F.array().cast("array<string>").alias("ft"), F.create_map().cast("map<string,string>").alias("fmt"), F.lit(True).alias("included"),
    )
    flags = F.sort_array(F.array_distinct(F.flatten(F.transform("x", lambda v: v["filter"]))))
    flags = F.when(F.size(flags) > 1, F.filter(flags, lambda f: f != "PASS")).otherwise(flags)
    total = lambda what: F.aggregate(F.filter("x", lambda v: v["qual"] > 0), F.lit(0.0), lambda acc, v: acc + what(v))
    weight = total(lambda v: v["weight"])
    passed = lambda v: (F.size(v["filter"]) == 0) | (v["filter"] == F.array(F.lit("PASS")))
    source = F.array_join(F.transform("x", lambda v: F.concat((v["src"] - 1).cast("string"), F.when(passed(v), "").otherwise("f"))), ",")
    formats = F.flatten(F.transform("x", lambda v: v["format"]))
    formats = F.when(F.size(formats) > 0, F.concat(F.array(F.lit("GT")), F.array_remove(F.array_distinct(formats), "GT"))).otherwise(formats)
    sites = per.select(
        F.col("new_id").alias("site_id"), "chrom", "pos", F.get(F.filter(F.transform("x", lambda v: v["id"]), lambda i: i.isNotNull()), F.lit(0)).alias("id"), F.col("merged_ref").alias("ref"), F.col("alts").alias("alt"),
        F.when(weight > 0, F.round(total(lambda v: v["qual"] * v["weight"]) / weight, 2)).alias("qual"), flags.alias("filter"), F.map_concat(_merged_info(info), F.create_map(F.lit("SF"), source)).alias("info"),
        formats.alias("format"), F.col("new_id").alias("line_no"), _summed("AN", False).alias("_sum_an"), _summed("AC", True).alias("_sum_ac"),
    )
    if all(c.samples.isEmpty() for c in cohorts):
        kept = F.map_filter(F.create_map(F.lit("AN"), F.col("_sum_an"), F.lit("AC"), F.col("_sum_ac")), lambda k, v: v.isNotNull())
        sites = sites.withColumn("info", F.map_concat("info", kept))
    else:
        sites = filled_counts(sites, calls)  # absent calls have no alleles
    calls = calls.unionByName(absent)
    sites = sites.drop("_sum_an", "_sum_ac").withColumn("info_raw", F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))
    lines = list(dict.fromkeys(h for c in cohorts for h in c.header if h.startswith("##") and not h.startswith("##fileformat")))
    return Cohort(sites, calls, samples, ["##fileformat=VCFv4.2", *lines], declared)


def _summed(key: str, by_allele: bool) -> Column:
    """The sum of INFO AN or AC over the inputs that have it, as text; null if none has."""
    text = lambda v: F.get(F.transform(F.filter(v["info"], lambda e: e["key"] == key), lambda e: e["value"]), F.lit(0))
    new = lambda v: reindexed(text(v), "A", v["back"], F.size(v["alts"]) + 1) if by_allele else text(v)
    every = F.filter(F.transform("y", new), lambda t: t.isNotNull())
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    sums = F.aggregate(every, F.array().cast("array<bigint>"), lambda acc, v: F.zip_with(acc, F.split(v, ","), lambda a, b: F.coalesce(a, F.lit(0)) + number(b)))
    return F.when(F.size(every) > 0, F.array_join(F.transform(sums, lambda n: n.cast("string")), ","))


def concatenated(cohorts: list[Cohort]) -> Cohort:
    """The records of inputs with the same samples, in the order of chromosome and position, with their calls.  Samples stand in
    the first input's order, whatever theirs; another set of samples is an error.  Header lines are united."""
    names = [[r["sample_id"] for r in c.samples.orderBy("sample_idx").collect()] for c in cohorts]
    for i, own in enumerate(names[1:], 2):
        if sorted(own) != sorted(names[0]):
            raise ValueError(f"input {i} has other samples than the first: {sorted(set(own) ^ set(names[0]))[:5]}")
    n = len(cohorts)
    new_id = lambda i: (F.col("site_id") * n + i).alias("site_id")
    sites = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.sites.withColumn("site_id", new_id(i)) for i, c in enumerate(cohorts)])
    calls = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.calls.withColumn("site_id", new_id(i)) for i, c in enumerate(cohorts)])
    placed = numbered(sites).withColumn("line_no", F.col("line").cast("long")).drop("line")
    fields: dict[tuple[str, str], Field] = {}
    for c in cohorts:
        for f in c.fields:
            fields.setdefault((f.kind, f.id), f)
    lines = list(dict.fromkeys(h for c in cohorts for h in c.header if h.startswith("##")))
    return Cohort(placed, calls, cohorts[0].samples, lines, list(fields.values()))
