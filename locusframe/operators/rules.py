"""Filters and edits of a user's own, as column expressions over one INFO or FORMAT field each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.alleles import event_type, gt_text
from locusframe.schema import Cohort

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """A rule on the records that have a field.

    ``tag`` is INFO/key, FORMAT/key or empty for every record.  The field's value goes to the functions: the text of an INFO
    key, an array of the samples' texts in their order ('.' where there is none) of a FORMAT key, a true column else.
    ``fails``: the record gets the rule's name in FILTER, or loses it.  ``info``: INFO keys to set (null removes one), on
    records where ``where`` holds.  ``filters``: further FILTER names and whether they hold.  ``missing``: genotypes
    become unknown where it holds for the sample's own text.  ``apply_to``: all, snps or indels, by the kinds of the ALTs."""

    name: str
    tag: str = ""
    fails: Test | None = None
    info: dict[str, Test] = field(default_factory=dict)
    where: Test | None = None
    filters: dict[str, Test] = field(default_factory=dict)
    missing: Test | None = None
    apply_to: str = "all"


def _named(tag: str) -> str:
    return f"_fmt_{tag}"


def apply_rules(cohort: Cohort, rules: list[Rule]) -> Cohort:
    """The cohort under ``rules``, all of which see the records as they were; edits of one key follow the rules' order.

    FILTER becomes PASS where a rule was asked and no name is left."""
    sites, calls = cohort.sites, cohort.calls
    tags = sorted({r.tag.removeprefix("FORMAT/") for r in rules if r.tag.startswith("FORMAT/")})
    text = lambda t: F.coalesce(gt_text() if t == "GT" else F.element_at("fmt", t), F.lit("."))
    if tags:
        one = F.struct("sample_idx", *[text(t).alias(_named(t)) for t in tags])
        per = calls.join(cohort.samples, "sample_id").groupBy("site_id").agg(F.array_sort(F.collect_list(one)).alias("_each"))
        sites = sites.join(per, "site_id", "left").withColumns({_named(t): F.col(f"_each.{_named(t)}") for t in tags})
    kinds = F.transform("alt", lambda a: event_type(F.col("ref"), a))
    wanted = {"all": F.lit(True), "snps": F.array_contains(kinds, "s"), "indels": F.array_contains(kinds, "i")}
    info, given, asked, met = F.col("info"), F.filter("filter", lambda f: f != "PASS"), F.lit(False), []

    def match(r: Rule) -> tuple[Column, Column]:
        """(the field's value, whether the record has it and is of the rule's kind)"""
        if r.tag.startswith("INFO/"):
            key = r.tag.removeprefix("INFO/")
            return F.element_at("info", key), F.map_contains_key("info", key) & wanted[r.apply_to]
        if r.tag.startswith("FORMAT/"):
            key = r.tag.removeprefix("FORMAT/")
            return F.col(_named(key)), F.array_contains("format", key) & F.col(_named(key)).isNotNull() & wanted[r.apply_to]
        return F.lit(True), wanted[r.apply_to]

    for r in rules:
        value, has = match(r)
        has = F.coalesce(has, F.lit(False))
        asked = asked | has
        for name, fails in [*([(r.name, r.fails)] if r.fails else []), *r.filters.items()]:
            bad = has & F.coalesce(fails(value), F.lit(False))
            given = F.when(bad, F.array_union(given, F.array(F.lit(name)))).when(has, F.array_remove(given, name)).otherwise(given)
        where = has & (F.coalesce(r.where(value), F.lit(False)) if r.where else F.lit(True))
        for key, make in r.info.items():
            new = make(value)
            rest = F.map_filter(info, _other(key))
            info = F.when(where & new.isNotNull(), F.map_concat(rest, F.create_map(F.lit(key), new.cast("string")))).when(where, rest).otherwise(info)
        if r.missing:
            key = r.tag.removeprefix("FORMAT/")
            met.append((F.coalesce(r.missing(text(key)), F.lit(False)), F.array_contains("format", key) & wanted[r.apply_to]))
    edited = sites.withColumns({"_info": info, "_filter": F.when(asked & (F.size(given) == 0), F.array(F.lit("PASS"))).when(asked, F.array_sort(given)).otherwise(F.col("filter"))})
    if met:
        marks = sites.select("site_id", *[has.alias(f"_has{i}") for i, (_, has) in enumerate(met)])
        calls = calls.join(marks, "site_id")
        lost = F.lit(False)
        for i, (test, _) in enumerate(met):
            lost = lost | (F.col(f"_has{i}") & test)
        calls = calls.withColumn("_lost", F.coalesce(lost, F.lit(False)))
        gone = lambda a: F.when(~F.col("_lost"), F.col(a))
        calls = calls.withColumns({"a1": gone("a1"), "a2": gone("a2")}).drop("_lost", *[f"_has{i}" for i in range(len(met))])
    edited = edited.withColumns({"info": F.col("_info"), "filter": F.col("_filter")}).drop("_info", "_filter", "_each", *[_named(t) for t in tags])
    return cohort.with_(sites=edited, calls=calls)


def _other(key: str) -> Callable[[Column, Column], Column]:
    return lambda k, v: k != key


def item(value: Column, i: int) -> Column:
    """Number ``i`` of a list, from 0; null if it is none."""
    return F.get(F.split(value, ","), F.lit(i)).try_cast("double")


def n_carriers(values: Column) -> Column:
    """How many of the samples' genotypes have an ALT."""
    return F.size(F.filter(values, lambda g: F.exists(F.split(g, r"[/|]"), lambda a: (a != "0") & (a != "."))))


def heterozygous(values: Column) -> Column:
    """Whether any sample's PL of three values is least for the heterozygous genotype."""
    return F.exists(values, lambda v: (item(v, 1) < item(v, 0)) & (item(v, 1) < item(v, 2)))


#: Rules as users write them: frequencies, kinds, support, single tags taken apart, edits and masks.
EXAMPLES = [
    Rule("MinAF", "INFO/AF1", fails=lambda v: v.try_cast("double") < 0.01),
    Rule("Indel", "INFO/INDEL", fails=lambda v: F.lit(True), apply_to="indels"),
    Rule("FewAlts", "INFO/DP4", fails=lambda v: 0.1 * (item(v, 0) + item(v, 1)) <= item(v, 2) + item(v, 3), apply_to="snps"),
    Rule("NoHets", "FORMAT/PL", fails=heterozygous, apply_to="snps"),
    Rule("SplitPV4", "INFO/PV4", info={f"PV{i}": (lambda v, i=i: F.get(F.split(v, ","), F.lit(i))) for i in range(4)}),
    Rule("Silly", where=lambda _: F.col("id").isNotNull() & (F.element_at("info", "DP").try_cast("int") > 5), info={"SILLY": lambda _: F.lit(None).cast("string")}),
    Rule("XY", filters={"XY": lambda _: ~F.coalesce(F.element_at("info", "XY").try_cast("double") == 42, F.lit(False))}),
    Rule("Singleton", "FORMAT/GT", where=lambda v: n_carriers(v) == 1, info={"SINGLETON": lambda _: F.lit("1")}),
    Rule("MinSampleDP", "FORMAT/DP", missing=lambda v: v.try_cast("double") < 2),
]
