"""Filters of samples, sites and calls, applied in a fixed order: samples, site filters in the order of the fields of
``Filters``, call masks between the phase filter and the frequency filters.  All conditions hold together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.alleles import hwe_exact, is_indel, n_alleles
from locusframe.operators.counts import allele_counts, biallelic, site_totals
from locusframe.operators.intervals import containing
from locusframe.schema import Cohort


def keep_samples(cohort: Cohort, samples: DataFrame) -> Cohort:
    """samples: (sample_id)."""
    s = samples.select("sample_id").distinct()
    return cohort.with_(samples=cohort.samples.join(s, "sample_id", "left_semi"), calls=cohort.calls.join(s, "sample_id", "left_semi"))


def remove_samples(cohort: Cohort, samples: DataFrame) -> Cohort:
    s = samples.select("sample_id").distinct()
    return cohort.with_(samples=cohort.samples.join(s, "sample_id", "left_anti"), calls=cohort.calls.join(s, "sample_id", "left_anti"))


def draw_samples(cohort: Cohort, n: int, seed: int = 0) -> Cohort:
    """``n`` samples by a seeded hash, so that reruns agree."""
    return keep_samples(cohort, cohort.samples.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id").cast("binary")), "sample_id").limit(n))


@dataclass(frozen=True)
class Filters:
    """None means: not asked for.  Ranges are inclusive."""

    indels: bool | None = None
    exclude_ids: tuple[str, ...] | None = None
    ids: tuple[str, ...] | None = None
    keep_filtered: tuple[str, ...] | None = None
    remove_filtered_all: bool = False
    remove_filtered: tuple[str, ...] | None = None
    chrom: tuple[str, ...] | None = None
    not_chrom: tuple[str, ...] | None = None
    from_bp: int | None = None
    to_bp: int | None = None
    positions: DataFrame | None = None
    exclude_positions: DataFrame | None = None
    positions_overlap: DataFrame | None = None
    exclude_positions_overlap: DataFrame | None = None
    bed: DataFrame | None = None
    exclude_bed: DataFrame | None = None
    min_alleles: int | None = None
    max_alleles: int | None = None
    keep_info: tuple[str, ...] | None = None
    remove_info: tuple[str, ...] | None = None
    min_q: float | None = None
    min_mean_dp: float | None = None
    max_mean_dp: float | None = None
    mask: DataFrame | None = None
    mask_min: int = 0
    invert_mask: bool = False
    phased: bool = False
    min_gq: float | None = None
    min_dp: int | None = None
    max_dp: int | None = None
    remove_filtered_geno_all: bool = False
    remove_filtered_geno: tuple[str, ...] | None = None
    maf: float | None = None
    max_maf: float | None = None
    non_ref_af: float | None = None
    max_non_ref_af: float | None = None
    non_ref_af_any: float | None = None
    max_non_ref_af_any: float | None = None
    max_missing: float | None = None
    mac: int | None = None
    max_mac: int | None = None
    non_ref_ac: int | None = None
    max_non_ref_ac: int | None = None
    non_ref_ac_any: int | None = None
    max_non_ref_ac_any: int | None = None
    max_missing_count: int | None = None
    hwe: float | None = None
    thin: int | None = None


def _within(x: Column, low, high) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (x >= low)
    if high is not None:
        out = out & (x <= high)
    return out


def _asked(*values) -> bool:
    return any(v is not None for v in values)


def site_filters(sites: DataFrame, f: Filters) -> DataFrame:
    """The filters that need the site's own columns or a side table only."""
    if f.indels is not None:
        sites = sites.filter(is_indel() if f.indels else ~is_indel())
    if f.exclude_ids is not None:
        sites = sites.filter(F.coalesce(~F.col("id").isin(*f.exclude_ids), F.lit(True)))
    if f.ids is not None:
        sites = sites.filter(F.coalesce(F.col("id").isin(*f.ids), F.lit(False)))
    words = lambda v: F.array(*[F.lit(x) for x in v])
    passed = (F.size("filter") == 0) | (F.get("filter", F.lit(0)) == "PASS")
    if f.keep_filtered is not None:
        sites = sites.filter(F.arrays_overlap("filter", words(f.keep_filtered)))
    if f.remove_filtered_all:
        sites = sites.filter(passed)
    if f.remove_filtered is not None:
        sites = sites.filter(passed | ~F.arrays_overlap("filter", words(f.remove_filtered)))
    if f.chrom is not None:
        sites = sites.filter(F.col("chrom").isin(*f.chrom))
        if len(f.chrom) == 1:  # a range is of one chromosome
            sites = sites.filter(_within(F.col("pos"), f.from_bp, f.to_bp))
    if f.not_chrom is not None:
        sites = sites.filter(~F.col("chrom").isin(*f.not_chrom))
    if f.positions is not None:
        sites = sites.join(f.positions, ["chrom", "pos"], "left_semi")
    if f.exclude_positions is not None:
        sites = sites.join(f.exclude_positions, ["chrom", "pos"], "left_anti")
    for listed, how in ((f.positions_overlap, "left_semi"), (f.exclude_positions_overlap, "left_anti")):
        if listed is not None:
            bases = sites.select("site_id", "chrom", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.length("ref") - 1)).alias("pos"))
            sites = sites.join(bases.join(listed, ["chrom", "pos"], "left_semi").select("site_id").distinct(), "site_id", how)
    for bed, how in ((f.bed, "left_semi"), (f.exclude_bed, "left_anti")):
        if bed is not None:
            longest = F.greatest(F.length("ref"), F.coalesce(F.array_max(F.transform("alt", F.length)), F.lit(1)))
            sites = containing(sites.withColumn("_span", longest), bed, span="_span", how=how).drop("_span")
    sites = sites.filter(_within(n_alleles(), f.min_alleles, f.max_alleles))
    if f.keep_info is not None:
        sites = sites.filter(F.exists(words(f.keep_info), lambda k: F.map_contains_key("info", k)))
    if f.remove_info is not None:
        sites = sites.filter(~F.exists(words(f.remove_info), lambda k: F.map_contains_key("info", k)))
    if f.min_q is not None:
        sites = sites.filter(F.coalesce("qual", F.lit(-1.0)) >= f.min_q)
    if f.mask is not None:  # chunks (chrom, start, digits): the digit of base start + i is digits[i]
        size = f.mask.select(F.max(F.length("digits"))).first()[0] or 1
        chunk = f.mask.withColumn("_chunk", F.floor((F.col("start") - 1) / size))
        digit = F.substr("digits", F.col("pos") - F.col("start") + 1, F.lit(1)).cast("int")
        ok = (digit > f.mask_min) if f.invert_mask else (digit <= f.mask_min)
        sites = sites.withColumn("_chunk", F.floor((F.col("pos") - 1) / size)).join(chunk, ["chrom", "_chunk"]).filter(ok).drop("_chunk", "start", "digits")
    return sites


def mask_calls(calls: DataFrame, f: Filters) -> DataFrame:
    """Masks, not removals: included becomes false."""
    ok = F.col("included")
    if f.min_gq is not None:
        ok = ok & (F.coalesce("gq", F.lit(-1.0)) >= f.min_gq)
    if f.min_dp is not None:
        ok = ok & (F.coalesce("dp", F.lit(-1)) >= f.min_dp)
    if f.max_dp is not None:
        ok = ok & (F.coalesce("dp", F.lit(-1)) <= f.max_dp)
    flags = F.coalesce("ft", F.array().cast("array<string>"))
    if f.remove_filtered_geno_all:
        ok = ok & ((F.size(flags) == 0) | (F.get(flags, F.lit(0)) == "PASS"))
    if f.remove_filtered_geno is not None:
        ok = ok & ~F.arrays_overlap(flags, F.array(*[F.lit(x) for x in f.remove_filtered_geno]))
    return calls.withColumn("included", ok)


def thin(sites: DataFrame, distance: int, width: int = 100_000) -> DataFrame:
    """Greedy along each chromosome: a site stays if it lies ``distance`` or more behind the last one that stayed.

    What the walk does within a block of positions depends only on where it starts there.  So first each block tells, for
    every place at which a walk that comes from the block before can start (the sites within the first ``distance`` bases, and
    the first one behind them), the last site that it keeps; few places lead to different ones.  A walk over the blocks of
    a chromosome, a few rows each, says where each block is really entered, and then the blocks are walked by themselves."""
    if distance <= 0:
        return sites
    width = max(width, 2 * distance)
    rows = sites.select("site_id", "chrom", "pos", "line_no").withColumn("_block", F.floor(F.col("pos") / width).cast("long"))

    def last_kept(pos: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For walks that keep pos[start], the positions that they keep last."""
        nxt = np.searchsorted(pos, pos + distance)
        end = np.arange(len(pos))
        for i in range(len(pos) - 1, -1, -1):
            if nxt[i] < len(pos):
                end[i] = end[nxt[i]]
        return pos[end[start]]

    def told(g: pd.DataFrame) -> pd.DataFrame:
        pos = np.unique(g["pos"].to_numpy())
        block = int(g["_block"].iloc[0])
        n = int(np.searchsorted(pos, block * width + distance))
        ends = last_kept(pos, np.arange(min(n + 1, len(pos))))
        final = np.append(ends[1:] != ends[:-1], True)  # the last place of those that lead to one end
        return pd.DataFrame({"chrom": g["chrom"].iloc[0], "_block": block, "place": pos[: len(ends)][final], "end": ends[final]})

    def entered(g: pd.DataFrame) -> pd.DataFrame:
        out, reach = [], None
        for block, part in g.sort_values(["_block", "place"]).groupby("_block", sort=True):
            out.append((block, -(2**62) if reach is None else reach))
            k = 0 if reach is None else int(np.searchsorted(part["place"].to_numpy(), reach))
            if k < len(part):  # else the block's sites all lie before the reach
                reach = int(part["end"].iloc[k]) + distance
        return pd.DataFrame(out, columns=["_block", "reach"]).assign(chrom=g["chrom"].iloc[0])

    def walked(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["pos", "line_no"])
        kept, reach = [], int(g["reach"].iloc[0])
        for site, pos in zip(g["site_id"], g["pos"]):
            if pos >= reach:
                kept.append(site)
                reach = pos + distance
        return pd.DataFrame({"site_id": kept})

    ends = rows.groupBy("chrom", "_block").applyInPandas(told, "chrom string, _block long, place long, end long")
    starts = ends.groupBy("chrom").applyInPandas(entered, "_block long, reach long, chrom string")  # a few rows a block
    kept = rows.join(starts, ["chrom", "_block"]).groupBy("chrom", "_block").applyInPandas(walked, "site_id long")
    return sites.join(kept, "site_id", "left_semi")


def apply(cohort: Cohort, f: Filters) -> Cohort:
    """The cohort with its calls masked and its sites filtered; calls of removed sites go."""
    sites, calls = site_filters(cohort.sites, f), cohort.calls
    if _asked(f.min_mean_dp, f.max_mean_dp) or f.phased:
        dp = F.when(F.coalesce("dp", F.lit(-1)) >= 0, F.col("dp")).otherwise(0)  # an unknown depth counts as a call
        per = calls.filter("included").groupBy("site_id").agg((F.sum(dp) / F.count("*")).alias("m"), F.bool_and("phased").alias("ph"))
        per = per.filter(_within(F.col("m"), f.min_mean_dp, f.max_mean_dp) & (F.col("ph") if f.phased else F.lit(True)))
        sites = sites.join(per.select("site_id"), "site_id", "left_semi")
    calls = mask_calls(calls, f)
    now = cohort.with_(sites=sites, calls=calls)
    frequency = (f.maf, f.max_maf, f.non_ref_af, f.max_non_ref_af, f.non_ref_af_any, f.max_non_ref_af_any, f.mac, f.max_mac, f.non_ref_ac, f.max_non_ref_ac, f.non_ref_ac_any, f.max_non_ref_ac_any)
    if _asked(*frequency):
        rows = allele_counts(now).withColumn("freq", F.when(F.col("n_called") > 0, F.col("count") / F.col("n_called")))
        alt = F.col("allele_idx") > 0
        every = lambda c: F.coalesce(F.bool_and(F.when(alt, c)), F.lit(True))
        some = lambda c: F.coalesce(F.bool_or(F.when(alt, c)), F.lit(False))
        conditions = []
        if _asked(f.maf, f.max_maf):
            conditions.append(_within(F.min(F.least(F.col("freq"), 1 - F.col("freq"))), f.maf, f.max_maf))
        if _asked(f.non_ref_af, f.max_non_ref_af):
            conditions.append(every(_within(F.col("freq"), f.non_ref_af, f.max_non_ref_af)))
        if _asked(f.non_ref_af_any, f.max_non_ref_af_any):
            conditions.append(some(_within(F.col("freq"), f.non_ref_af_any, f.max_non_ref_af_any)))
        if _asked(f.mac, f.max_mac):
            conditions.append(_within(F.min(F.least("count", F.col("n_called") - F.col("count"))), f.mac, f.max_mac))
        if _asked(f.non_ref_ac, f.max_non_ref_ac):
            conditions.append(every(_within(F.col("count"), f.non_ref_ac, f.max_non_ref_ac)))
        if _asked(f.non_ref_ac_any, f.max_non_ref_ac_any):
            conditions.append(some(_within(F.col("count"), f.non_ref_ac_any, f.max_non_ref_ac_any)))
        per = rows.groupBy("site_id").agg(*[c.alias(f"c{i}") for i, c in enumerate(conditions)])
        for i in range(len(conditions)):
            per = per.filter(f"c{i}")
        sites = sites.join(per.select("site_id"), "site_id", "left_semi")
    if _asked(f.max_missing, f.max_missing_count):
        per = site_totals(calls)
        if f.max_missing is not None:
            per = per.filter(F.col("n_called") >= f.max_missing * F.col("n_chr"))
        if f.max_missing_count is not None:
            per = per.filter(F.col("n_chr") - F.col("n_called") <= f.max_missing_count)
        sites = sites.join(per.select("site_id"), "site_id", "left_semi")
    if f.hwe is not None:
        per = biallelic(now, diploid=False).withColumn("p", hwe_exact(F.col("r"), F.col("h"), F.col("a"))["p_hwe"]).filter(F.col("p") >= f.hwe)
        sites = sites.join(per.select("site_id"), "site_id", "left_semi")
    if f.thin is not None:
        sites = thin(sites, f.thin)
    return cohort.with_(sites=sites, calls=calls.join(sites.select("site_id"), "site_id", "left_semi"))
