"""Statistics of samples."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import alleles, ratio
from locusframe.operators.counts import biallelic, called
from locusframe.operators.sets import numbered
from locusframe.schema import Cohort
from locusframe.tables import written


def heterozygosity(cohort: Cohort) -> DataFrame:
    """Observed and expected homozygous calls and the inbreeding coefficient, over polymorphic biallelic diploid sites."""
    s = biallelic(cohort).filter("n_ref > 0 and n_alt > 0").withColumn("n", (F.col("n_ref") + F.col("n_alt")).cast("double"))
    f = F.col("n_ref") / F.col("n")
    s = s.select("site_id", (1 - 2 * f * (1 - f) * (F.col("n") / (F.col("n") - 1))).alias("e"))
    calls = cohort.calls.filter("included and a1 is not null and a2 is not null").join(s, "site_id")
    per = calls.groupBy("sample_id").agg(F.count_if(F.col("a1") == F.col("a2")).alias("o_hom"), F.sum("e").alias("e_hom"), F.count("*").alias("n_sites"))
    return per.withColumn("f", ratio(F.col("o_hom") - F.col("e_hom"), F.col("n_sites") - F.col("e_hom")))


def depth(cohort: Cohort) -> DataFrame:
    dp = F.when(F.col("included") & (F.col("dp") >= 0), F.col("dp").cast("long"))
    per = cohort.calls.groupBy("sample_id").agg(F.count(dp).alias("n_sites"), F.sum(dp).alias("s"))
    return per.select("sample_id", "n_sites", ratio(F.col("s"), F.col("n_sites")).alias("mean_depth"))


def missing(cohort: Cohort) -> DataFrame:
    """Calls, masked ones, those whose first allele is missing, and their share of the calls that are not masked."""
    per = cohort.calls.groupBy("sample_id").agg(F.count("*").alias("n_data"), F.count_if(~F.col("included")).alias("n_filtered"), F.count_if(F.col("included") & F.col("a1").isNull()).alias("n_miss"))
    return per.withColumn("f_miss", ratio(F.col("n_miss"), F.col("n_data") - F.col("n_filtered")))


def burden(cohort: Cohort, derived: bool = False) -> DataFrame:
    """Homozygous reference, heterozygous, homozygous ALT and missing calls (half missing ones are missing).  ``derived``: the
    ancestral allele (INFO AA) stands for the reference, and sites where it is unknown or no allele of theirs are left out."""
    a1, a2 = F.col("a1"), F.coalesce("a2", F.when(F.col("ploidy") == 1, F.col("a1")))
    known = F.col("included") & a1.isNotNull() & a2.isNotNull()
    calls, base = cohort.calls, F.lit(0)
    if derived:
        place = F.array_position(alleles(), F.upper(F.element_at("info", "AA"))).cast("int") - 1
        calls, base = calls.join(cohort.sites.select("site_id", place.alias("_base")).filter("_base >= 0"), "site_id"), F.col("_base")
    return calls.groupBy("sample_id").agg(
        F.count_if(known & (a1 == base) & (a2 == base)).alias("n_hom_ref"), F.count_if(known & (a1 != a2)).alias("n_het"),
        F.count_if(known & (a1 != base) & (a1 == a2)).alias("n_hom_alt"), F.count_if(~known).alias("n_miss"),
    )


def frequency_burden(cohort: Cohort, once: bool = False) -> DataFrame:
    """For each sample and count of an ALT allele in the cohort: how many such alleles the sample carries.  ``once``: a
    homozygous call counts once."""
    alts = called(cohort.calls).filter("allele > 0")
    counts = alts.groupBy("site_id", "allele").agg(F.count("*").alias("cohort_count"))
    own = alts.groupBy("site_id", "allele", "sample_id").agg(F.lit(1).cast("long").alias("n") if once else F.count("*").alias("n"))
    return own.join(counts, ["site_id", "allele"]).groupBy("sample_id", "cohort_count").agg(F.sum("n").alias("n_alleles"))


def _dosages(cohort: Cohort) -> DataFrame:
    """(site_id, sample_id, x, p): REF copies of complete calls, and the REF frequency, of biallelic diploid sites."""
    s = biallelic(cohort).select("site_id", "n_ref", "n_alt")
    calls = cohort.calls.filter("included and a1 is not null and a2 is not null")
    x = (F.col("a1") == 0).cast("int") + (F.col("a2") == 0).cast("int")
    return calls.join(s, "site_id").select("site_id", "sample_id", x.alias("x"), "n_ref", "n_alt")


def _pairs(rows: DataFrame, ordered: bool) -> DataFrame:
    b = rows.select("site_id", F.col("sample_id").alias("sample_b"), F.col("x").alias("y"))
    pairs = rows.withColumnRenamed("sample_id", "sample_a").join(b, "site_id")
    return pairs if ordered else pairs.filter(F.col("sample_a") <= F.col("sample_b"))


def relatedness(cohort: Cohort) -> DataFrame:
    """Yang et al.'s A_jk over polymorphic sites: (x - 2p)(y - 2p) / 2p(1 - p), and 1 + its variant on the diagonal."""
    rows = _dosages(cohort).filter("n_ref > 0 and n_alt > 0").withColumn("p", F.col("n_ref") / (F.col("n_ref") + F.col("n_alt")))
    x, y, p = F.col("x"), F.col("y"), F.col("p")
    off = (x - 2 * p) * (y - 2 * p) / (2 * p * (1 - p))
    own = (x * x - (1 + 2 * p) * x + 2 * p * p) / (2 * p * (1 - p))
    same = F.col("sample_a") == F.col("sample_b")
    per = _pairs(rows, False).groupBy("sample_a", "sample_b").agg(F.avg(F.when(same, own).otherwise(off)).alias("m"))
    return per.select("sample_a", "sample_b", F.when(same, 1 + F.col("m")).otherwise(F.col("m")).alias("a_jk"))


def kinship(cohort: Cohort) -> DataFrame:
    """KING's phi = (both het - 2 opposite homozygotes) / (hets of one + hets of the other), for every ordered pair.

    A sample's genotypes at 64 sites are three words of bits, so a pair costs one row for 64 sites."""
    numbers = numbered(cohort.sites.select("site_id", "chrom", "pos")).select("site_id", (F.col("line") % 64).cast("int").alias("bit"), F.floor(F.col("line") / 64).alias("block"))
    bit = F.expr("shiftleft(1L, bit)")
    word = lambda x: F.bit_or(F.when(F.col("x") == x, bit).otherwise(F.lit(0).cast("long")))
    words = _dosages(cohort).join(numbers, "site_id").groupBy("sample_id", "block").agg(word(0).alias("none"), word(1).alias("het"), word(2).alias("both"))
    a = words.select("block", F.col("sample_id").alias("sample_a"), *[F.col(c).alias(f"{c}_a") for c in ("none", "het", "both")])
    b = words.select("block", F.col("sample_id").alias("sample_b"), *[F.col(c).alias(f"{c}_b") for c in ("none", "het", "both")])
    n = lambda w: F.sum(F.bit_count(w)).cast("long")
    c = F.col
    known = lambda k: c(f"none_{k}").bitwiseOR(c(f"het_{k}")).bitwiseOR(c(f"both_{k}"))
    per = a.join(b, "block").groupBy("sample_a", "sample_b").agg(
        n(c("het_a").bitwiseAND(c("het_b"))).alias("n_aa_aa"), n(c("none_a").bitwiseAND(c("both_b")).bitwiseOR(c("both_a").bitwiseAND(c("none_b")))).alias("n_opposite"),
        n(c("het_a").bitwiseAND(known("b"))).alias("n_het_a"), n(c("het_b").bitwiseAND(known("a"))).alias("n_het_b"), n(known("a").bitwiseAND(known("b"))).alias("n_shared"),
    )
    per = per.filter("n_shared > 0").drop("n_shared")
    return per.withColumn("phi", ratio(F.col("n_aa_aa") - 2 * F.col("n_opposite"), F.col("n_het_a") + F.col("n_het_b")))


def homozygous_runs(cohort: Cohort, prior: float = 0.05, error: float = 0.01, generations: float = 4, least: float = 0.99, width: int = 1_000_000) -> DataFrame:
    """Long runs of homozygosity: a two-state hidden Markov model along each (sample, chromosome), 1 cM a megabase; runs of
    sites whose posterior of autozygosity exceeds ``least``.

    The probabilities on both sides of a stretch of ``width`` bases act on it through one 2 x 2 matrix, the product of its
    sites' transitions and emissions.  So stretches are multiplied out by themselves, a walk over a row a stretch gives each
    of them what comes in from the left and from the right, the posteriors are taken stretch by stretch, and runs that
    meet at a border are joined."""
    s = biallelic(cohort).filter("n_alt > 0").withColumn("het", F.col("h") / F.greatest(F.col("r") + F.col("h") + F.col("a"), F.lit(1))).select("site_id", "chrom", "pos", "het")
    calls = cohort.calls.filter("included and a1 is not null and a2 is not null").join(s, "site_id")
    by = ["sample_id", "chrom"]
    rows = calls.select(*by, "pos", "het", (F.col("a1") != F.col("a2")).alias("is_het"), F.floor(F.col("pos") / width).cast("long").alias("stretch"))

    def step(gap: np.ndarray | float) -> np.ndarray:
        """Transitions over gaps in bases, from the row's state to the column's."""
        e = 1 - np.exp(-2 * generations * np.asarray(gap, float) / 1e8)
        return np.stack([np.stack([1 - (1 - prior) * e, (1 - prior) * e], -1), np.stack([prior * e, 1 - prior * e], -1)], -2)

    def emissions(g: pd.DataFrame) -> np.ndarray:
        own, het = g["is_het"].to_numpy(), g["het"].to_numpy()
        return np.stack([np.where(own, error, 1 - error), np.where(own, het, 1 - het)], axis=1)

    def multiplied(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        pos, emit = g["pos"].to_numpy(), emissions(g)
        product, steps = np.diag(emit[0]), step(np.diff(pos))
        for i in range(1, len(pos)):
            product = (product @ steps[i - 1]) * emit[i]
            product /= product.sum()
        return pd.DataFrame([(g["sample_id"].iloc[0], g["chrom"].iloc[0], g["stretch"].iloc[0], int(pos[0]), int(pos[-1]), *product.ravel())], columns=[*by, "stretch", "first", "last", "m00", "m01", "m10", "m11"])

    def passed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("stretch")
        m = g[["m00", "m01", "m10", "m11"]].to_numpy().reshape(-1, 2, 2)
        n, between = len(g), step(g["first"].to_numpy()[1:] - g["last"].to_numpy()[:-1])
        left, right = np.empty((n, 2)), np.ones((n, 2))
        left[0] = prior, 1 - prior
        for k in range(1, n):
            left[k] = left[k - 1] @ m[k - 1] @ between[k - 1]
            left[k] /= left[k].sum()
        for k in range(n - 2, -1, -1):
            right[k] = between[k] @ m[k + 1] @ right[k + 1]
            right[k] /= right[k].sum()
        return pd.DataFrame({"sample_id": g["sample_id"], "chrom": g["chrom"], "stretch": g["stretch"], "place": np.arange(n), "l0": left[:, 0], "l1": left[:, 1], "r0": right[:, 0], "r1": right[:, 1]})

    def runs(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        pos, emit, own = g["pos"].to_numpy(), emissions(g), g["is_het"].to_numpy()
        n, steps = len(pos), step(np.diff(pos))
        ahead, back = np.empty((n, 2)), np.empty((n, 2))
        ahead[0], back[-1] = g[["l0", "l1"]].to_numpy()[0] * emit[0], g[["r0", "r1"]].to_numpy()[0]
        for i in range(1, n):
            ahead[i] = (ahead[i - 1] @ steps[i - 1]) * emit[i]
            ahead[i] /= ahead[i].sum()
        for i in range(n - 2, -1, -1):
            back[i] = steps[i] @ (emit[i + 1] * back[i + 1])
            back[i] /= back[i].sum()
        both = ahead * back
        inside = both[:, 0] / both.sum(axis=1) > least
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(int)))
        found = [(g["sample_id"].iloc[0], g["chrom"].iloc[0], int(g["place"].iloc[0]), int(pos[a]), int(pos[b - 1]), b - a, int((~own[a:b]).sum()), a == 0, b == n) for a, b in zip(edges[::2], edges[1::2])]
        return pd.DataFrame(found, columns=[*by, "place", "start", "end", "n", "n_hom", "at_first", "at_last"])

    products = rows.groupBy(*by, "stretch").applyInPandas(multiplied, "sample_id string, chrom string, stretch long, first long, last long, m00 double, m01 double, m10 double, m11 double")
    sides = products.groupBy(*by).applyInPandas(passed, "sample_id string, chrom string, stretch long, place long, l0 double, l1 double, r0 double, r1 double")  # a row a stretch
    parts = rows.join(sides, [*by, "stretch"]).groupBy(*by, "stretch").applyInPandas(runs, "sample_id string, chrom string, place long, start int, end int, n int, n_hom int, at_first boolean, at_last boolean")
    order = Window.partitionBy(*by).orderBy("start")
    goes_on = F.col("at_first") & F.lag("at_last").over(order) & (F.lag("place").over(order) == F.col("place") - 1)
    joined = parts.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    per = joined.groupBy(*by, "run").agg(F.min("start").alias("auto_start"), F.max("end").alias("auto_end"), F.sum("n").cast("int").alias("n_variants"), F.sum("n_hom").cast("int").alias("n_hom"))
    return per.select("chrom", "auto_start", "auto_end", "n_variants", "n_hom", "sample_id")


#: Samples whose covariance the driver solves, their square is what it gets; leading components beyond.
MAX_SAMPLES, TOP = 5000, 10


def _normalised(cohort: Cohort, normalise: bool) -> DataFrame:
    """(site_id, sample_id, m) of polymorphic sites at which every sample is called."""
    n = cohort.samples.count()
    rows = _dosages(cohort).filter(F.col("n_ref") + F.col("n_alt") == 2 * n).filter("n_ref > 0 and n_alt > 0")
    p = F.col("n_alt") / (2.0 * n)
    m = (2 - F.col("x")) - 2 * p
    return rows.select("site_id", "sample_id", (m / F.sqrt(p * (1 - p)) if normalise else m).alias("m"))


def leading_components(cohort: Cohort, k: int, normalise: bool = True, rounds: int = 300, tolerance: float = 1e-10, more: int = 8, seed: int = 1) -> DataFrame:
    """The ``k`` leading eigenvectors of the samples' covariance, as ``principal_components`` gives them, for any number of samples.

    Block power iteration: a table of a few vectors (``k`` and ``more``) goes through the sites and back, as sums by site and
    by sample, until the eigenvalues of the first k settle; ArithmeticError if they don't in ``rounds``.  The driver gets
    the vectors' products with each other alone, never a number a sample."""
    rows = written(_normalised(cohort, normalise), "genotypes")
    n_sites, names = rows.select("site_id").distinct().count(), rows.select("sample_id").distinct()
    n = names.count()
    if n_sites <= n:
        raise ValueError("principal components need more sites than samples")
    width = min(n, k + more)
    at = lambda i: F.get("v", F.lit(i))
    packed = lambda prefix: F.array(*[F.col(f"{prefix}{i}") for i in range(width)])

    def through(vectors: DataFrame) -> DataFrame:
        """(sample_id, v, w): w = covariance times v."""
        site = rows.join(vectors, "sample_id").groupBy("site_id").agg(*[F.sum(F.col("m") * at(i)).alias(f"s{i}") for i in range(width)])
        back = rows.join(site.select("site_id", packed("s").alias("v")), "site_id").groupBy("sample_id").agg(*[(F.sum(F.col("m") * at(i)) / n_sites).alias(f"s{i}") for i in range(width)])
        return vectors.join(back.select("sample_id", packed("s").alias("w")), "sample_id")

    def products(table: DataFrame, a: str, b: str) -> np.ndarray:
        pairs = [F.sum(F.get(a, F.lit(i)) * F.get(b, F.lit(j))) for i in range(width) for j in range(width)]
        return np.array(table.agg(F.array(*pairs).alias("p")).first()["p"]).reshape(width, width)

    def turned(table: DataFrame, column: str, by: np.ndarray) -> DataFrame:
        """The vectors of ``column`` times a small matrix."""
        sums = [F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in by[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for j in range(width)]
        return table.select("sample_id", F.array(*sums).alias("v"))

    def unit(table: DataFrame, column: str) -> DataFrame:
        """Orthonormal vectors that span those of ``column``."""
        values, vectors = np.linalg.eigh(products(table, column, column))
        good = np.maximum(values, values[-1] * 1e-15)
        return turned(table, column, vectors / np.sqrt(good))

    start = names.select("sample_id", F.array(*[F.expr(f"(xxhash64(sample_id, {i}, {seed}) % 1000003) / 1000003.0D") for i in range(width)]).alias("v"))
    vectors, before = written(unit(written(start, "vectors"), "v"), "vectors"), None
    for _ in range(rounds):
        vectors = written(unit(vectors, "v"), "vectors")  # twice is enough for rounding
        table = written(through(vectors), "vectors")
        square = products(table, "v", "w")
        values, turn = np.linalg.eigh((square + square.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        if before is not None and np.all(np.abs(values[:k] - before) <= tolerance * max(values[0], 1e-300)) or width == n:
            table = written(turned(table, "v", turn), "vectors")
            largest = table.select("sample_id", F.posexplode("v").alias("c", "value")).filter(F.col("c") < k)
            sign = largest.groupBy("c").agg(F.signum(F.max_by("value", F.struct(F.abs("value"), "sample_id"))).alias("sign"))
            found = largest.join(sign, "c").select("sample_id", (F.col("c") + 1).alias("component"), F.element_at(F.array(*[F.lit(float(x)) for x in values[:k]]), F.col("c") + 1).alias("eigenvalue"), (F.col("value") * F.col("sign")).alias("value"))
            return found.withColumn("component", F.col("component").cast("int"))
        before = values[:k].copy()
        vectors = written(unit(table, "w"), "vectors")
    raise ArithmeticError(f"the leading eigenvalues did not settle in {rounds} rounds")


def principal_components(cohort: Cohort, normalise: bool = True, k: int | None = None) -> DataFrame:
    """Eigenvectors of the samples' covariance (Patterson et al. 2006): a row a sample and component, with its eigenvalue; the
    first ``k``, or all.  All of more than MAX_SAMPLES samples would be their square on the driver: there, and wherever k is
    given for so many, the leading ones come from ``leading_components``, TOP of them if k isn't given."""
    spark = cohort.sites.sparkSession
    if cohort.samples.count() > MAX_SAMPLES:
        return leading_components(cohort, k or TOP, normalise)
    rows = _normalised(cohort, normalise)
    n_sites = rows.select("site_id").distinct().count()
    other = rows.select("site_id", F.col("sample_id").alias("sample_b"), F.col("m").alias("w"))
    gram = rows.join(other, "site_id").groupBy("sample_id", "sample_b").agg(F.sum(F.col("m") * F.col("w")).alias("g")).collect()
    names = sorted({r["sample_id"] for r in gram})
    at = {s: i for i, s in enumerate(names)}
    if n_sites <= len(names):
        raise ValueError("principal components need more sites than samples")
    matrix = np.zeros((len(names), len(names)))
    for r in gram:
        matrix[at[r["sample_id"]], at[r["sample_b"]]] = r["g"] / n_sites
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values)
    out = [(names[i], c + 1, float(values[j]), float(vectors[i, j] * np.sign(vectors[np.abs(vectors[:, j]).argmax(), j]))) for c, j in enumerate(order[:k]) for i in range(len(names))]
    return spark.createDataFrame(out, "sample_id string, component int, eigenvalue double, value double")


def loadings(cohort: Cohort, k: int, normalise: bool = True) -> DataFrame:
    """Weights of the sites in the first ``k`` components: sum of m e / sum of e squared."""
    e = principal_components(cohort, normalise).filter(F.col("component") <= k)
    rows = _normalised(cohort, normalise).join(e, "sample_id")  # k rows a sample
    per = rows.groupBy("site_id", "component").agg((F.sum(F.col("m") * F.col("value")) / F.sum(F.col("value") * F.col("value"))).alias("loading"))
    return per.join(cohort.sites.select("site_id", "chrom", "pos"), "site_id").select("chrom", "pos", "component", "loading")
