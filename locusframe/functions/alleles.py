"""Column expressions over sites and calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double, null where d is 0."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def alleles() -> Column:
    return F.concat(F.array("ref"), F.col("alt"))


def allele(i: Column) -> Column:
    """The allele numbered ``i`` (0: REF); '.' if there is none."""
    return F.coalesce(F.get(alleles(), i), F.lit("."))


def n_alleles() -> Column:
    return F.size("alt") + 1


def is_snp() -> Column:
    return (F.length("ref") == 1) & (F.size("alt") > 0) & F.forall("alt", lambda x: F.length(x) == 1)


def is_biallelic_snp() -> Column:
    return (F.length("ref") == 1) & (F.size("alt") == 1) & (F.length(F.get("alt", F.lit(0))) == 1)


def is_indel() -> Column:
    """REF longer than one base, or an ALT of another length (so a multi-base substitution counts too)."""
    return (F.length("ref") != 1) | F.exists("alt", lambda x: F.length(x) != F.length("ref"))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def event_type(ref: Column, alt: Column) -> Column:
    """r reference, s single or multiple substitution, i indel, b breakend, u symbolic, o other."""
    plain = alt.rlike("^[ACGTNacgtn]+$") & ref.rlike("^[ACGTNacgtn]+$")
    short = F.least(F.length(ref), F.length(alt))
    indel = (F.length(ref) != F.length(alt)) & (F.substr(ref, F.lit(1), short) == F.substr(alt, F.lit(1), short))
    tail = (F.length(ref) != F.length(alt)) & (F.substr(ref, F.length(ref) - short + 1) == F.substr(alt, F.length(alt) - short + 1))
    return (
        F.when(alt.isin(".") | (alt == ref), "r").when(alt.rlike(r"[\[\]]") | alt.rlike(r"^\..+|.+\.$"), "b").when(alt.startswith("<"), "u")
        .when(plain & (F.length(ref) == F.length(alt)), "s").when(plain & (indel | tail), "i").otherwise("o")
    )


def decode_genotype() -> Column:
    """A call as bases, with its phase: A/G, A|., haploid A."""
    one = lambda i: F.when(i.isNull(), ".").otherwise(allele(i))
    mark = F.when(F.col("phased"), "|").otherwise("/")
    return F.when(F.col("ploidy") == 1, one(F.col("a1"))).otherwise(F.concat(one(F.col("a1")), mark, one(F.col("a2"))))


def gt_text() -> Column:
    """A call as in a file: 0/1, .|., haploid 1; masked calls are missing."""
    one = lambda a: F.when(F.col("included") & a.isNotNull(), a.cast("string")).otherwise(".")
    mark = F.when(F.col("phased") & F.col("included"), "|").otherwise("/")
    return F.when(F.col("ploidy") == 1, one(F.col("a1"))).otherwise(F.concat(one(F.col("a1")), mark, one(F.col("a2"))))


def normalize_alleles(ref: Column, alt: Column) -> Column:
    """(ref, alt, shift): the common end, then the common start, cut off; one base of each stays."""
    ends = lambda a, b, n: F.substr(a, F.length(a) - n + 1, n) == F.substr(b, F.length(b) - n + 1, n)
    room = F.least(F.length(ref), F.length(alt)) - 1
    steps = lambda top: F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
    tail = F.coalesce(F.array_max(F.filter(steps(room), lambda n: ends(ref, alt, n))), F.lit(0))
    r, a = F.substr(ref, F.lit(1), F.length(ref) - tail), F.substr(alt, F.lit(1), F.length(alt) - tail)
    head = F.coalesce(F.array_max(F.filter(steps(F.least(F.length(r), F.length(a)) - 1), lambda n: F.substr(r, F.lit(1), n) == F.substr(a, F.lit(1), n))), F.lit(0))
    return F.struct(F.substr(r, head + 1).alias("ref"), F.substr(a, head + 1).alias("alt"), head.alias("shift"))


def hwe_exact(hom1: Column, het: Column, hom2: Column) -> Column:
    """(p_hwe, p_lo, p_hi) of the exact test of Hardy-Weinberg proportions: the probabilities of all heterozygote counts
    given the alleles, relative to the observed one, by the recurrence between neighbours: up from it, then down."""
    rare, n, seen = (2 * F.least(hom1, hom2) + het).cast("int"), (hom1 + het + hom2).cast("int"), het.cast("int")
    counts = lambda ok, first, last, by: F.when(ok, F.sequence(first, last, F.lit(by))).otherwise(F.array().cast("array<int>"))
    homs = lambda k: (rare - k) / 2
    more = lambda k: 4.0 * homs(k) * (n - k - homs(k)) / ((k + 2.0) * (k + 1.0))
    fewer = lambda k: k * (k - 1.0) / (4.0 * (homs(k) + 1) * (n - k - homs(k) + 1))

    def step(side: str, ratio_: Column, acc: Column) -> Column:
        # w: the weight at hand; one: the observed one's; sums of both sides and of weights no greater than the observed one.
        # All are scaled down together where a weight becomes very large.
        scaled = F.transform(F.array(acc["w"] * ratio_), lambda w: F.struct(w.alias("w"), F.when(w > 1e200, 1e-200).otherwise(1.0).alias("s")))

        def add(x: Column) -> Column:
            w, one = x["w"] * x["s"], acc["one"] * x["s"]
            sums = {k: acc[k] * x["s"] + (w if k == side else 0.0) for k in ("up", "down")}
            return F.struct(w.alias("w"), one.alias("one"), sums["up"].alias("up"), sums["down"].alias("down"), (acc["le"] * x["s"] + F.when(w <= one * (1 + 1e-9), w).otherwise(0.0)).alias("le"))

        return F.get(F.transform(scaled, add), F.lit(0))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("one"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0.0).alias("le"))
    up = F.aggregate(counts(rare - 2 >= seen, seen, F.greatest(rare - 2, seen), 2), start, lambda acc, k: step("up", more(k), acc), lambda x: F.struct(x["one"].alias("w"), *[x[c].alias(c) for c in ("one", "up", "down", "le")]))

    def ended(x: Column) -> Column:
        total = x["one"] + x["up"] + x["down"]
        value = lambda v, name: F.least(F.lit(1.0), v / total).alias(name)
        return F.struct(value(x["one"] + x["le"], "p_hwe"), value(x["one"] + x["down"], "p_lo"), value(x["one"] + x["up"], "p_hi"))

    out = F.aggregate(counts(seen >= 2, F.greatest(seen, F.lit(2)), F.lit(2) + seen % 2, -2), up, lambda acc, k: step("down", fewer(k), acc), ended)
    return F.when(n > 0, out).otherwise(F.struct(F.lit(1.0).alias("p_hwe"), F.lit(1.0).alias("p_lo"), F.lit(1.0).alias("p_hi")))
