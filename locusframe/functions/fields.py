"""Fields whose values are listed by allele or genotype (Number=A, R and G), as column expressions.

A genotype (i, j) of alleles j <= i has the place i (i + 1) / 2 + j in a list by genotype; a haploid call's list is by
allele.  ``back`` renumbers alleles: back[k] is the old number of new allele k, null where there was none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.schema import Field

#: Taken as listed by allele or genotype even where no header says so.
KNOWN = {"INFO": {"AC": "A", "AF": "A"}, "FORMAT": {"AC": "A", "AF": "A", "GL": "G", "PL": "G", "GP": "G"}}


def numbers(fields: list[Field], kind: str) -> dict[str, str]:
    """The fields of ``kind`` that are listed by allele (A, R) or genotype (G)."""
    own = {f.id: f.number for f in fields if f.kind == kind}
    return {k: n for k, n in (KNOWN[kind] | own).items() if n in ("A", "R", "G")}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(v), with v computed once."""
    return F.transform(F.array(value), body)[0]


def genotypes(n: Column) -> Column:
    """All (i, j), j <= i < n, in the order of lists by genotype."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def reindexed(text: Column, number: str, back: Column, n_old: Column, haploid: Column | None = None) -> Column:
    """The list ``text`` under new allele numbers, '.' where the old one says nothing.  A list by genotype of another length
    than the alleles ask for becomes '.'; of a single allele's, only the call (``haploid``) tells whether it is by allele."""

    def listed(v: Column) -> Column:
        take = lambda i: F.coalesce(F.get(v["x"], i), F.lit("."))

        def pair(p: Column) -> Column:
            a, b = F.get(v["back"], p["i"]), F.get(v["back"], p["j"])
            high, low = F.greatest(a, b), F.least(a, b)
            return F.when(a.isNull() | b.isNull(), ".").otherwise(take((high * (high + 1) / 2 + low).cast("int")))

        alleles = F.transform(v["back"], take)
        if number == "A":
            out = F.transform(F.slice(v["back"], 2, F.size(v["back"])), lambda b: take(b - 1))
        elif number == "R":
            out = alleles
        else:
            diploid = (F.size(v["x"]) == v["n"] * (v["n"] + 1) / 2) & ~((v["n"] == 1) & v["haploid"])
            out = F.when(diploid, F.transform(genotypes(F.size(v["back"])), pair)).when(F.size(v["x"]) == v["n"], alleles).otherwise(F.array(F.lit(".")))
        return F.when(F.size(out) == 0, ".").otherwise(F.array_join(out, ","))

    return F.when(text == ".", text).when(text.isNotNull(), once(F.struct(F.split(text, ",").alias("x"), back.alias("back"), n_old.alias("n"), (F.lit(False) if haploid is None else haploid).alias("haploid")), listed))


def reindexed_map(entries: Column, kinds: dict[str, str], back: Column, n_old: Column, haploid: Column | None = None) -> Column:
    """A map of fields with those of ``kinds`` renumbered."""

    def value(key: Column, text: Column) -> Column:
        out = text
        for number in ("A", "R", "G"):
            if own := [k for k, n in kinds.items() if n == number]:
                out = F.when(key.isin(*own), reindexed(text, number, back, n_old, haploid)).otherwise(out)
        return out

    return F.transform_values(entries, value)


def likeliest(text: Column, n_alleles: Column, sign: int = 1) -> Column:
    """Of a list by genotype (least is best, or with sign -1 greatest): (i, j, best), j <= i; null where it is missing, partly
    missing or of a length that fits no ploidy.  A haploid list gives i = j."""

    def best(v: Column) -> Column:
        n, haploid = v["n"], F.size(v["x"]) == v["n"]
        fits = (haploid | (F.size(v["x"]) == n * (n + 1) / 2)) & ~F.exists(v["x"], lambda s: s.try_cast("double").isNull())
        pairs = F.when(haploid, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), i.alias("j")))).otherwise(genotypes(n))
        least = F.array_min(F.zip_with(v["x"], pairs, lambda s, p: F.struct((s.try_cast("double") * sign).alias("v"), p["i"].alias("i"), p["j"].alias("j"))))
        return F.when(fits, once(least, lambda m: F.struct(m["i"].alias("i"), m["j"].alias("j"), (m["v"] * sign).alias("best"))))

    return F.when(text.isNotNull() & (text != "."), once(F.struct(F.split(text, ",").alias("x"), n_alleles.alias("n")), best))


def as_diploid(text: Column, n_alleles: Column) -> Column:
    """A list of PL as numbers by genotype; a haploid one has 255 for every heterozygous genotype.  Null as in ``likeliest``."""

    def spread(v: Column) -> Column:
        n, x = v["n"], F.transform(v["x"], lambda s: s.try_cast("double"))
        haploid = F.transform(genotypes(n), lambda p: F.when(p["i"] == p["j"], F.get(x, p["i"])).otherwise(255.0))
        return F.when(F.exists(x, lambda s: s.isNull()), F.lit(None)).when(F.size(x) == n, haploid).when(F.size(x) == n * (n + 1) / 2, x)

    return F.when(text.isNotNull() & (text != "."), once(F.struct(F.split(text, ",").alias("x"), n_alleles.alias("n")), spread))


def reploided(text: Column, n_alleles: Column, was: Column, wanted: Column) -> Column:
    """A list by genotype for another ploidy: from diploid to haploid the homozygous values, from haploid to diploid '.' for
    the heterozygous genotypes."""

    def changed(v: Column) -> Column:
        n = v["n"]
        down = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(v["x"], (i * (i + 3) / 2).cast("int")), F.lit(".")))
        up = F.transform(genotypes(n), lambda p: F.when(p["i"] == p["j"], F.coalesce(F.get(v["x"], p["i"]), F.lit("."))).otherwise("."))
        return F.when((v["was"] == 2) & (v["wanted"] < 2), F.array_join(down, ",")).when((v["was"] == 1) & (v["wanted"] == 2), F.array_join(up, ",")).otherwise(F.array_join(v["x"], ","))

    return F.when(text == ".", text).when(text.isNotNull(), once(F.struct(F.split(text, ",").alias("x"), n_alleles.alias("n"), was.cast("int").alias("was"), wanted.cast("int").alias("wanted")), changed))
