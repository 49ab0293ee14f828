"""Linkage disequilibrium: joins of sites with sites.  A bound in bases or in sites is required within a chromosome; the
join has the chromosome, a word and a position bin as equal keys.

A word holds one bit for each of 64 samples (or chromosome copies): which are called, and which have one or two copies of
REF.  The sums over samples that all measures need are counts of bits that two sites' words share, so a site has one row
for 64 samples, and what is joined does not grow with each of them.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import n_alleles, ratio
from locusframe.operators.counts import biallelic
from locusframe.operators.sets import numbered
from locusframe.schema import Cohort
from locusframe.tables import written

BITS = ["called", "one", "two"]
#: Blocks where all sites are paired with all: how many there are at least if they hold LEAST sites or more, and the sites and bytes of one at most.
BLOCKS, LEAST, MOST, BYTES = 32, 512, 1 << 16, 1 << 26
#: Up to so many words a site has a column a word, beyond it arrays.
COLUMNS = 16
ACROSS = ["chrom_a", "pos_a", "chrom_b", "pos_b"]


def _words(calls: DataFrame, index: Column, copies: Column, sites: DataFrame) -> DataFrame:
    """calls: (site_id, ...), a row a sample or copy with its number and its REF copies.  (site_id, chrom, pos, rn, word, called, one, two)."""
    rows = calls.withColumns({"_i": index, "_x": copies}).withColumns({"word": F.floor(F.col("_i") / 64), "_bit": F.expr("shiftleft(1L, cast(_i % 64 as int))")})
    own = lambda c: F.bit_or(F.when(c, F.col("_bit")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("site_id", "word").agg(F.bit_or("_bit").alias("called"), own(F.col("_x") == 1).alias("one"), own(F.col("_x") == 2).alias("two")).join(sites, "site_id")


def _placed(sites: DataFrame, counted: bool) -> DataFrame:
    """(site_id, chrom, pos, rn): rn counts the sites in order, where that is asked for."""
    own = sites.select("site_id", "chrom", "pos")
    return numbered(own).withColumnRenamed("line", "rn") if counted else own.withColumn("rn", F.lit(None).cast("long"))


def _genotypes(cohort: Cohort, counted: bool = False) -> DataFrame:
    calls = cohort.calls.filter("included and a1 is not null and a2 is not null").join(cohort.samples, "sample_id")
    return _words(calls, F.col("sample_idx"), (F.col("a1") == 0).cast("int") + (F.col("a2") == 0).cast("int"), _placed(biallelic(cohort), counted))


def _haplotypes(cohort: Cohort, counted: bool = False) -> DataFrame:
    """As ``_genotypes`` for phased sites, a bit a chromosome copy."""
    copies = F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("a1").alias("a")), F.struct(F.lit(1).alias("copy"), F.col("a2").alias("a")))).alias("c")
    calls = cohort.calls.filter("included").join(cohort.samples, "sample_id").select("site_id", "sample_idx", copies).filter("c.a is not null")
    return _words(calls, F.col("sample_idx") * 2 + F.col("c.copy"), (F.col("c.a") == 0).cast("int"), _placed(biallelic(cohort).filter("all_phased"), counted))


def _near(rows: DataFrame, bp: int, bp_min: int, sites: int | None, sites_min: int, key: str = "word", values: list[str] = BITS) -> DataFrame:
    """Pairs of rows of one chromosome and ``key``, the first before the second, within the bounds."""
    names = ["site_id", "pos", "rn", *values]
    a = rows.select("chrom", key, *[F.col(c).alias(f"{c}_a") for c in names], F.explode(F.array(*[F.floor(F.col("pos") / bp) + k for k in (0, 1)])).alias("bin"))
    b = rows.select("chrom", key, *[F.col(c).alias(f"{c}_b") for c in names], F.floor(F.col("pos") / bp).alias("bin"))
    apart, order = F.col("pos_b") - F.col("pos_a"), F.col("rn_b") - F.col("rn_a")
    kept = ((apart > 0) | (apart == 0) & (F.col("site_id_b") > F.col("site_id_a"))) & (apart <= bp) & (apart >= bp_min)
    if sites or sites_min > 1:
        kept = kept & (order >= sites_min) & (order <= sites if sites else F.lit(True))
    return a.join(b, ["chrom", key, "bin"]).filter(kept)


def _both(a: str, b: str) -> Column:
    return F.sum(F.bit_count(F.col(f"{a}_a").bitwiseAND(F.col(f"{b}_b"))).cast("long"))


def _genotype_sums(both: Callable[[str, str], Column]) -> list[Column]:
    own, other = [(both(c, "called"), both("called", c)) for c in ("one", "two")]
    product = both("one", "one") + 2 * (both("one", "two") + both("two", "one")) + 4 * both("two", "two")
    return [both("called", "called").alias("n_indv"), (own[0] + 2 * other[0]).alias("sx"), (own[1] + 2 * other[1]).alias("sy"), product.alias("sxy"), (own[0] + 4 * other[0]).alias("sxx"), (own[1] + 4 * other[1]).alias("syy")]


def _phase_sums(both: Callable[[str, str], Column]) -> list[Column]:
    return [both("called", "called").alias("n_chr"), both("one", "called").alias("sx"), both("called", "one").alias("sy"), both("one", "one").alias("sxy")]


def _correlation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return _correlated(pairs.groupBy(*keys).agg(*_genotype_sums(_both)), keys)


def _correlated(per: DataFrame, keys: list[str]) -> DataFrame:
    """Squared correlation of the REF copies, from sums of integers over the samples called at both sites."""
    per, n = per.filter("n_indv > 0"), F.col("n_indv")
    cov, vx, vy = n * F.col("sxy") - F.col("sx") * F.col("sy"), n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return per.withColumn("r2", ratio(cov.cast("double") * cov, vx.cast("double") * vy)).select(*keys, "n_indv", "r2")


def _phase(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return _phased(pairs.groupBy(*keys).agg(*_phase_sums(_both)), keys)


def _phased(per: DataFrame, keys: list[str]) -> DataFrame:
    """r2, D and D' of two phased sites."""
    per, n = per.filter("n_chr > 0"), F.col("n_chr").cast("double")
    p, q = F.col("sx") / n, F.col("sy") / n
    d = F.col("sxy") / n - p * q
    most = F.when(d < 0, F.least(p * q, (1 - p) * (1 - q))).otherwise(F.least(p * (1 - q), (1 - p) * q))
    exact = F.col("sxy") * F.col("n_chr") - F.col("sx") * F.col("sy")
    same = (F.col("sx") == 0) | (F.col("sx") == F.col("n_chr")) | (F.col("sy") == 0) | (F.col("sy") == F.col("n_chr"))
    per = per.withColumns({"r2": F.when(~same, d * d / (p * (1 - p) * q * (1 - q))), "d": F.when(exact == 0, 0.0).otherwise(d), "d_prime": F.when(~same, F.when(exact == 0, 0.0).otherwise(d / most))})
    return per.select(*keys, "n_chr", "r2", "d", "d_prime")


def _limit(rows: DataFrame, min_r2: float) -> DataFrame:
    return rows.filter(F.col("r2") >= min_r2) if min_r2 > 0 else rows


def genotype_r2(cohort: Cohort, bp: int, bp_min: int = 0, sites: int | None = None, sites_min: int = 0, min_r2: float = 0.0) -> DataFrame:
    pairs = _near(_genotypes(cohort, bool(sites) or sites_min > 1), bp, bp_min, sites, sites_min)
    return _limit(_correlation(pairs, ["chrom", "pos_a", "pos_b", "site_id_a", "site_id_b"]), min_r2).drop("site_id_a", "site_id_b")


def haplotype_r2(cohort: Cohort, bp: int, bp_min: int = 0, sites: int | None = None, sites_min: int = 0, min_r2: float = 0.0) -> DataFrame:
    pairs = _near(_haplotypes(cohort, bool(sites) or sites_min > 1), bp, bp_min, sites, sites_min)
    return _limit(_phase(pairs, ["chrom", "pos_a", "pos_b", "site_id_a", "site_id_b"]), min_r2).drop("site_id_a", "site_id_b")


def genotype_chisq(cohort: Cohort, bp: int) -> DataFrame:
    """Chi-square of the contingency table of unordered genotypes, any number of alleles, with its degrees of freedom and
    upper tail."""
    s = _placed(cohort.sites.filter(n_alleles() > 1), False)
    calls = cohort.calls.filter("included and a1 is not null and a2 is not null")
    rows = calls.join(s, "site_id").select("site_id", "chrom", "pos", "rn", "sample_id", (F.least("a1", "a2") * 1000 + F.greatest("a1", "a2")).alias("x"))
    keys = ["chrom", "pos_a", "pos_b", "site_id_a", "site_id_b"]
    cells = _near(rows, bp, 0, None, 0, "sample_id", ["x"]).groupBy(*keys, "x_a", "x_b").agg(F.count("*").alias("o"))
    of = Window.partitionBy(*keys)
    cells = cells.withColumns({"n": F.sum("o").over(of), "ra": F.sum("o").over(Window.partitionBy(*keys, "x_a")), "rb": F.sum("o").over(Window.partitionBy(*keys, "x_b"))})
    # sum of (o - e)^2 / e over all cells, empty ones too, is n (sum of o^2 / (row * column) - 1)
    per = cells.groupBy(*keys).agg(F.first("n").alias("n_indv"), F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("rb"))).alias("q"), F.countDistinct("x_a").alias("rows"), F.countDistinct("x_b").alias("cols"))
    per = per.withColumns({"chisq": F.greatest(F.lit(0.0), F.col("n_indv") * (F.col("q") - 1)), "dof": (F.col("rows") - 1) * (F.col("cols") - 1)})
    return per.select("chrom", "pos_a", "pos_b", "n_indv", "chisq", "dof", F.when(F.col("dof") > 0, chisq_tail(F.col("chisq"), F.col("dof"))).alias("p_value"))


def chisq_tail(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution: closed sums for even and odd degrees of freedom."""
    from math import pi, sqrt

    h = x / 2
    half = F.floor(dof / 2).cast("int")
    terms = lambda top, first, by: F.aggregate(
        F.when(top >= 1, F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.struct(first.cast("double").alias("t"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct((a["t"] * h / by(k)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    even = F.exp(-h) * terms(half, F.lit(1.0), lambda k: k)
    odd = erfc(F.sqrt(h)) + F.exp(-h) * terms(half, 2 * F.sqrt(h) / sqrt(pi), lambda k: k + 0.5)
    return F.when(dof % 2 == 0, even).otherwise(odd)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: a series below 2.5, a continued fraction beyond."""
    from math import pi, sqrt

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.cast("double").alias("t"), z.cast("double").alias("s")), lambda a, k: F.struct((a["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * k + 1)).alias("s")), lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z.cast("double"), lambda a, k: z + k / 2 / a)
    return F.when(z < 2.5, 1 - 2 / sqrt(pi) * F.exp(-z * z) * series).otherwise(F.exp(-z * z) / sqrt(pi) / fraction)


def _wide(rows: DataFrame, words: int) -> DataFrame:
    """A row a site, with all its words: columns called0, called1, ..., or arrays where there are many."""
    if words <= COLUMNS:
        every = [F.coalesce(F.max(F.when(F.col("word") == i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for c in BITS for i in range(words)]
        return rows.groupBy("site_id", "chrom", "pos").agg(*every)
    per = rows.groupBy("site_id", "chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct(*BITS)))).alias("_w"))
    every = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.element_at("_w", i.cast("long")))
    return per.withColumn("_w", every).select("site_id", "chrom", "pos", *[F.transform(f"_w.{c}", lambda x: F.coalesce(x, F.lit(0))).alias(c) for c in BITS])


def _shared(words: int) -> Callable[[str, str], Column]:
    """As ``_both`` within a row that has all words of both sites."""

    def both(a: str, b: str) -> Column:
        if words > COLUMNS:
            return F.aggregate(F.zip_with(f"{a}_a", f"{b}_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("long"), lambda n, x: n + x)
        return sum((F.bit_count(F.col(f"{a}{i}_a").bitwiseAND(F.col(f"{b}{i}_b"))) for i in range(1, words)), F.bit_count(F.col(f"{a}0_a").bitwiseAND(F.col(f"{b}0_b")))).cast("long")

    return both


def _across(rows: DataFrame, sums: Callable[[Callable[[str, str], Column]], list[Column]]) -> DataFrame:
    """Every pair of sites on different chromosomes with its ``sums``.  They are ready where the pair meets, so pairs are not
    shuffled.

    Blocks are stretches of the sites in the order of the chromosomes' names, in any order within one.  A site goes to the
    blocks with sites of chromosomes behind its own (as the first of a pair), and before it (as the second)."""
    rows = written(rows.select("site_id", "chrom", "pos", "word", *BITS), "words")
    words = int(rows.agg(F.max("word")).first()[0] or 0) + 1
    sites = written(_wide(rows, words), "sites")
    counts = sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("_n"))
    total = sites.count()
    size = min(max(ceil(total / BLOCKS), LEAST), MOST, max(LEAST, BYTES // (24 * words + 64)))
    last = max(0, ceil(total / size) - 1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a chromosome
    placed = sites.join(before, "chrom")
    mine = F.floor((F.col("_before") + F.pmod(F.xxhash64("site_id"), F.col("_n"))) / size)
    behind, ahead = F.floor((F.col("_before") + F.col("_n")) / size), F.floor((F.col("_before") - 1) / size)
    first = placed.filter(F.col("_before") + F.col("_n") < total).withColumns({"block_a": mine, "block_b": F.explode(F.sequence(behind, F.lit(last).cast("long")))})
    second = placed.filter("_before > 0").withColumns({"block_b": mine, "block_a": F.explode(F.sequence(F.lit(0).cast("long"), ahead))})
    parts = max(1, (last + 1) ** 2 // 8)  # as the pairs, not as the bytes of the sites
    side = lambda of, k: of.select("block_a", "block_b", *[F.col(c).alias(f"{c}_{k}") for c in ["_before", *sites.columns] if c != "site_id"]).repartition(parts, "block_a", "block_b")
    pairs = side(first, "a").hint("merge").join(side(second, "b"), ["block_a", "block_b"]).filter("_before_a < _before_b")
    # the partition's number is not deterministic, so that no filter on the sums passes: as a condition of the join, with the sums again
    # wherever they are used, it would be too long to be compiled
    return pairs.select(*ACROSS, *sums(_shared(words)), F.spark_partition_id().alias("_part")).filter("_part >= 0")


def genotype_r2_across(cohort: Cohort, min_r2: float = 0.0) -> DataFrame:
    """Every pair of sites on different chromosomes; thin or filter the sites first."""
    return _limit(_correlated(_across(_genotypes(cohort), _genotype_sums), ACROSS), min_r2)


def haplotype_r2_across(cohort: Cohort, min_r2: float = 0.0) -> DataFrame:
    return _limit(_phased(_across(_haplotypes(cohort), _phase_sums), ACROSS), min_r2)


def _listed(rows: DataFrame, positions: DataFrame, bp: int) -> DataFrame:
    """Listed sites with all others of their chromosome at most ``bp`` bases away, on either side."""
    mine, rest = rows.join(positions, ["chrom", "pos"], "left_semi"), rows.join(positions, ["chrom", "pos"], "left_anti")
    side = lambda of, k, bin_: of.select("chrom", "word", *[F.col(c).alias(f"{c}_{k}") for c in ("site_id", "pos", *BITS)], bin_.alias("bin"))
    a = side(mine, "a", F.explode(F.array(*[F.floor(F.col("pos") / bp) + k for k in (-1, 0, 1)])))
    b = side(rest, "b", F.floor(F.col("pos") / bp))
    return a.join(b, ["chrom", "word", "bin"]).filter(F.abs(F.col("pos_a") - F.col("pos_b")) <= bp)


def genotype_r2_listed(cohort: Cohort, positions: DataFrame, bp: int) -> DataFrame:
    return _correlation(_listed(_genotypes(cohort), positions, bp), ["chrom", "pos_a", "pos_b", "site_id_a", "site_id_b"]).drop("site_id_a", "site_id_b")


def haplotype_r2_listed(cohort: Cohort, positions: DataFrame, bp: int) -> DataFrame:
    return _phase(_listed(_haplotypes(cohort), positions, bp), ["chrom", "pos_a", "pos_b", "site_id_a", "site_id_b"]).drop("site_id_a", "site_id_b")
