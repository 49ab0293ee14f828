"""The registered queries over the mapped cohort, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import compare, export, filters, individual, ld, records, sequence, sets, site, windows
from locusframe.operators.filters import Filters
from locusframe.plans import mapping
from locusframe.plans.mapping import PRELUDE, SAMPLES
from locusframe.sources import vcf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, without a negative zero, so that both engines print them alike."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _counted(sql: str) -> str:
    """count_if(x) as a count, which is a BIGINT in both engines."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(name: str, make: Query, sql: str | None = None, prelude: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = _counted((PRELUDE if prelude else "") + sql)


def on_cohort(name: str, make: Callable, sql: str | None = None) -> None:
    query(name, lambda spark, sf_dir: make(mapping.cohort(spark, sf_dir)), sql)


R = "round({}, 6) + 0.0".format

# statistics of sites
on_cohort("site_freq", site.frequencies, f"SELECT chrom, pos, allele_idx, allele, n_chr, n_called, count, CASE WHEN n_called <> 0 THEN {R('count::DOUBLE / n_called::DOUBLE')} END AS freq FROM allele")
on_cohort("site_freq_derived", lambda c: site.frequencies(c, derived=True), f"""SELECT chrom, pos, CAST(row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN allele = aa THEN 0 ELSE 1 END, allele_idx) - 1 AS INT) AS allele_idx, allele, n_chr, n_called, count,
  CASE WHEN n_called <> 0 THEN {R('count::DOUBLE / n_called::DOUBLE')} END AS freq FROM (SELECT a.*, s.aa, max(CASE WHEN allele = aa THEN 1 ELSE 0 END) OVER (PARTITION BY a.site_id) AS has FROM allele a JOIN site s USING (site_id)) WHERE has = 1""")
on_cohort("site_counts", lambda c: site.frequencies(c).select("chrom", "pos", "allele", "n_chr", "count"), "SELECT chrom, pos, allele, n_chr, count FROM allele")
W = "CASE WHEN h % 2 = 0 THEN 0 ELSE 1 END"
on_cohort("site_hardy", site.hardy, f"""
, g AS (SELECT *, r + h + a AS n, 2 * least(r, a) + h AS rare FROM bi WHERE r + h + a > 0),
k AS (SELECT g.*, unnest(range((rare % 2)::BIGINT, (rare + 1)::BIGINT, 2)) AS k FROM g),
w AS (SELECT *, k * ln(2.0) - lgamma(k + 1) - lgamma((rare - k) // 2 + 1) - lgamma(n - k - (rare - k) // 2 + 1) AS lw FROM k),
w2 AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY site_id)) AS x FROM w),
w3 AS (SELECT *, max(CASE WHEN k = h THEN x END) OVER (PARTITION BY site_id) AS seen FROM w2),
p AS (SELECT site_id, sum(x) FILTER (x <= seen * (1 + 1e-9)) / sum(x) AS p_hwe, sum(x) FILTER (k <= h) / sum(x) AS p_lo, sum(x) FILTER (k >= h) / sum(x) AS p_hi FROM w3 GROUP BY site_id),
e AS (SELECT *, (2 * r + h) / (2.0::DOUBLE * n) AS f FROM g), f AS (SELECT *, f * f * n AS e_r, 2 * f * (1 - f) * n AS e_h, (1 - f) * (1 - f) * n AS e_a FROM e)
SELECT chrom, pos, r, h, a, {R('e_r')} AS e_r, {R('e_h')} AS e_h, {R('e_a')} AS e_a,
  round(CASE WHEN e_r > 0 THEN (r - e_r) * (r - e_r) / e_r ELSE 0 END + CASE WHEN e_h > 0 THEN (h - e_h) * (h - e_h) / e_h ELSE 0 END + CASE WHEN e_a > 0 THEN (a - e_a) * (a - e_a) / e_a ELSE 0 END, 6) + 0.0 AS chisq,
  round(least(1.0, p_hwe), 6) + 0.0 AS p_hwe, round(least(1.0, p_lo), 6) + 0.0 AS p_lo, round(least(1.0, p_hi), 6) + 0.0 AS p_hi FROM f JOIN p USING (site_id)""")
on_cohort("site_missing", site.missing, """SELECT chrom, pos, n_chr AS n_data, 0::BIGINT AS n_filtered, n_chr - n_called AS n_miss, round((n_chr - n_called)::DOUBLE / n_chr::DOUBLE, 6) + 0.0 AS f_miss FROM site JOIN tot USING (site_id)""")
on_cohort("site_depth", site.depth, "SELECT s.chrom, s.pos, coalesce(sum(dp), 0)::BIGINT AS sum_depth, coalesce(sum(dp * dp), 0)::BIGINT AS sumsq_depth FROM site s JOIN call c USING (site_id) GROUP BY site_id, s.chrom, s.pos")
on_cohort("site_mean_depth", site.mean_depth, """SELECT chrom, pos, round(s / nullif(n, 0)::DOUBLE, 6) + 0.0 AS mean_depth, round((q * n - s * s)::DOUBLE / nullif(n * (n - 1), 0)::DOUBLE, 6) + 0.0 AS var_depth
  FROM (SELECT chrom, pos, count(dp) AS n, sum(dp)::BIGINT AS s, sum(dp * dp)::BIGINT AS q FROM call GROUP BY ALL)""")
on_cohort("geno_depth", lambda c: site.genotype_depth(c, SAMPLES), "SELECT chrom, pos, " + ", ".join(f"coalesce(max(CASE WHEN sample_id = '{s}' THEN dp END), -1) AS {s}" for s in SAMPLES) + " FROM call GROUP BY chrom, pos")
on_cohort("site_quality", site.quality, f"SELECT chrom, pos, {R('qual')} AS qual FROM site")
on_cohort("singletons", site.singletons, """SELECT s.chrom, s.pos, CASE WHEN n = 1 THEN 'S' ELSE 'D' END AS kind, list_concat([s.ref], s.alt)[c.a + 1] AS allele, c.sample_id FROM site s JOIN
  (SELECT site_id, a, count(*) AS n, count(DISTINCT sample_id) AS k, min_by(sample_id, sample_idx) AS sample_id FROM copies GROUP BY site_id, a) c USING (site_id) WHERE n = 1 OR (n = 2 AND k = 1)""")
on_cohort("site_pi", site.pi, """SELECT chrom, pos, round(sum(count * (n_called - count))::DOUBLE / nullif(any_value(n_called) * (any_value(n_called) - 1), 0)::DOUBLE, 6) + 0.0 AS pi
  FROM allele JOIN (SELECT site_id FROM tot WHERE diploid) USING (site_id) GROUP BY site_id, chrom, pos""")
on_cohort("filter_summary", site.filter_summary, """, x AS (SELECT *, CASE WHEN len(filter) = 0 THEN '.' ELSE array_to_string(filter, ';') END AS filter_text, length(ref) = 1 AND length(alt[1]) = 1 AS base, ref || alt[1] IN ('AG', 'GA', 'CT', 'TC') AS ts FROM site)
  SELECT *, round(n_ts / nullif(n_tv, 0)::DOUBLE, 6) + 0.0 AS ts_tv FROM (SELECT filter_text, count(*) AS n_variants, count_if(base AND ts) AS n_ts, count_if(base AND NOT ts AND ref <> alt[1]) AS n_tv FROM x GROUP BY ALL)""")
query("mendel", lambda s, d: site.mendel(mapping.cohort(s, d), mapping.trios(s)), """, t AS (SELECT 'F' || CAST(k AS VARCHAR) AS family, k FROM (SELECT unnest([0, 3, 6, 9, 12, 15]) AS k))
  SELECT s.chrom, s.pos, s.ref, array_to_string(s.alt, ',') AS alt, t.family, c.a1 || '/' || c.a2 AS child_gt, f.a1 || '/' || f.a2 AS father_gt, m.a1 || '/' || m.a2 AS mother_gt
  FROM t JOIN full_call c ON c.sample_idx = k JOIN full_call f ON f.sample_idx = k + 1 AND f.site_id = c.site_id JOIN full_call m ON m.sample_idx = k + 2 AND m.site_id = c.site_id JOIN site s ON s.site_id = c.site_id
  WHERE NOT ((c.a1 IN (f.a1, f.a2) AND c.a2 IN (m.a1, m.a2)) OR (c.a2 IN (f.a1, f.a2) AND c.a1 IN (m.a1, m.a2)))""")

# statistics of samples
on_cohort("indv_het", individual.heterozygosity, """, e AS (SELECT site_id, 1 - 2 * (n_ref / (n_ref + n_alt)::DOUBLE) * (1 - n_ref / (n_ref + n_alt)::DOUBLE) * ((n_ref + n_alt)::DOUBLE / (n_ref + n_alt - 1)) AS e FROM bi WHERE n_ref > 0 AND n_alt > 0)
  SELECT sample_id, count_if(a1 = a2) AS o_hom, round(sum(e), 6) + 0.0 AS e_hom, count(*) AS n_sites, round((count_if(a1 = a2) - sum(e)) / (count(*) - sum(e)), 6) + 0.0 AS f FROM full_call JOIN e USING (site_id) GROUP BY sample_id""")
on_cohort("indv_depth", individual.depth, "SELECT sample_id, count(dp) AS n_sites, round(sum(dp) / count(dp)::DOUBLE, 6) + 0.0 AS mean_depth FROM call GROUP BY sample_id")
on_cohort("indv_missing", individual.missing, "SELECT sample_id, count(*) AS n_data, 0::BIGINT AS n_filtered, count_if(a1 IS NULL) AS n_miss, round(count_if(a1 IS NULL) / count(*)::DOUBLE, 6) + 0.0 AS f_miss FROM call GROUP BY sample_id")
on_cohort("indv_burden", individual.burden, """, x AS (SELECT sample_id, a1, coalesce(a2, CASE WHEN ploidy = 1 THEN a1 END) AS a2 FROM call)
  SELECT sample_id, count_if(a1 = 0 AND a2 = 0) AS n_hom_ref, count_if(a1 <> a2) AS n_het, count_if(a1 > 0 AND a1 = a2) AS n_hom_alt, count_if(a1 IS NULL OR a2 IS NULL) AS n_miss FROM x GROUP BY sample_id""")
on_cohort("indv_burden_derived", lambda c: individual.burden(c, derived=True), """, b AS (SELECT site_id, list_position(list_concat([ref], alt), aa) - 1 AS base FROM site WHERE list_contains(list_concat([ref], alt), aa)), x AS (SELECT sample_id, base, a1, coalesce(a2, CASE WHEN ploidy = 1 THEN a1 END) AS a2 FROM call JOIN b USING (site_id))
  SELECT sample_id, count_if(a1 = base AND a2 = base) AS n_hom_ref, count_if(a1 <> a2) AS n_het, count_if(a1 <> base AND a1 = a2) AS n_hom_alt, count_if(a1 IS NULL OR a2 IS NULL) AS n_miss FROM x GROUP BY sample_id""")
FREQ_BURDEN = """, k AS (SELECT site_id, a, count(*) AS cohort_count FROM copies WHERE a > 0 GROUP BY ALL), o AS (SELECT site_id, a, sample_id, {} AS n FROM copies WHERE a > 0 GROUP BY site_id, a, sample_id)
  SELECT sample_id, cohort_count, sum(n)::BIGINT AS n_alleles FROM o JOIN k USING (site_id, a) GROUP BY ALL"""
on_cohort("indv_freq_burden", individual.frequency_burden, FREQ_BURDEN.format("count(*)"))
on_cohort("indv_freq_burden2", lambda c: individual.frequency_burden(c, once=True), FREQ_BURDEN.format("1"))
DOSE = ", dose AS (SELECT c.site_id, sample_id, (a1 = 0)::INT + (a2 = 0)::INT AS x, n_ref, n_alt, n_ref / (n_ref + n_alt)::DOUBLE AS p FROM full_call c JOIN bi USING (site_id))\n"
on_cohort("relatedness", individual.relatedness, DOSE + """, y AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, CASE WHEN a.sample_id = b.sample_id THEN (a.x * a.x - (1 + 2 * a.p) * a.x + 2 * a.p * a.p) / (2 * a.p * (1 - a.p)) ELSE (a.x - 2 * a.p) * (b.x - 2 * a.p) / (2 * a.p * (1 - a.p)) END AS v
  FROM dose a JOIN dose b ON a.site_id = b.site_id AND a.sample_id <= b.sample_id WHERE a.n_ref > 0 AND a.n_alt > 0)
  SELECT sample_a, sample_b, round(CASE WHEN sample_a = sample_b THEN 1 ELSE 0 END + avg(v), 6) + 0.0 AS a_jk FROM y GROUP BY sample_a, sample_b""")
on_cohort("relatedness2", individual.kinship, DOSE + """, y AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, count_if(a.x = 1 AND b.x = 1) AS n_aa_aa, count_if(abs(a.x - b.x) = 2) AS n_opposite, count_if(a.x = 1) AS n_het_a, count_if(b.x = 1) AS n_het_b
  FROM dose a JOIN dose b ON a.site_id = b.site_id GROUP BY ALL) SELECT *, round((n_aa_aa - 2 * n_opposite) / nullif(n_het_a + n_het_b, 0)::DOUBLE, 6) + 0.0 AS phi FROM y""")




def _complete(spark: SparkSession, sf_dir: str):
    """All sites and samples of the mapped cohort; a call without a line item counts as two copies of REF."""
    c = mapping.cohort(spark, sf_dir)
    return c.with_(calls=c.calls.withColumns({"a1": F.coalesce("a1", F.lit(0)), "a2": F.when(F.col("ploidy") == 2, F.coalesce("a2", F.lit(0)))}))




def _with_runs(spark: SparkSession, sf_dir: str):
    """The complete cohort, in which every fourth sample is homozygous over every other stretch of 6000 bases."""
    c = _complete(spark, sf_dir)
    calls = c.calls.join(c.sites.select("site_id", "pos"), "site_id").join(c.samples, "sample_id")
    run = (F.col("sample_idx") % 4 == 0) & (F.floor(F.col("pos") / 6000) % 2 == 0) & F.col("a2").isNotNull()
    return c.with_(calls=calls.withColumn("a1", F.when(run, F.col("a2")).otherwise(F.col("a1"))).drop("pos", "sample_idx"))


query("lroh", lambda s, d: individual.homozygous_runs(_with_runs(s, d)))
query("pca", lambda s, d: individual.principal_components(_complete(s, d)))
query("pca_leading", lambda s, d: individual.leading_components(_complete(s, d), 2, more=30))
query("pca_loadings", lambda s, d: individual.loadings(_complete(s, d), 2))

# windows
on_cohort("snp_density", lambda c: windows.snp_density(c, 1000), """, s AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY site_id) AS before FROM site WHERE len(alt) > 0),
  b AS (SELECT chrom, pos // 1000 AS bin, count(*) AS n FROM s WHERE before IS NULL OR before <> pos GROUP BY ALL), e AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY chrom)
  SELECT chrom, (bin * 1000)::BIGINT AS bin_start, coalesce(n, 0) AS n_variants, round(coalesce(n, 0) / 1.0, 6) + 0.0 AS per_kb FROM e LEFT JOIN b USING (chrom, bin)""")
on_cohort("tstv_window", lambda c: windows.ts_tv(c, 5000), """, b AS (SELECT chrom, pos // 5000 AS bin, count(*) AS n, count_if(ts) AS t FROM snp GROUP BY ALL), e AS (SELECT chrom, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY chrom)
  SELECT chrom, (bin * 5000)::BIGINT AS bin_start, coalesce(n, 0) AS n_snps, coalesce(round(t / nullif(n - t, 0)::DOUBLE, 6), 0.0) + 0.0 AS ts_tv FROM e LEFT JOIN b USING (chrom, bin)""")
on_cohort("tstv_summary", windows.ts_tv_summary, """, m AS (SELECT least(ref, b) || greatest(ref, b) AS model FROM snp UNION ALL SELECT CASE WHEN ts THEN 'Ts' ELSE 'Tv' END FROM snp)
  SELECT e.model, count(m.model) AS n FROM (SELECT unnest(['AC', 'AG', 'AT', 'CG', 'CT', 'GT', 'Ts', 'Tv']) AS model) e LEFT JOIN m USING (model) GROUP BY e.model""")
on_cohort("tstv_by_count", windows.ts_tv_by_count, """SELECT *, round(n_ts / nullif(n_tv, 0)::DOUBLE, 6) + 0.0 AS ts_tv FROM (SELECT n_alt AS alt_count, count_if(ts) AS n_ts, count_if(NOT ts) AS n_tv FROM snp JOIN bia USING (site_id) GROUP BY n_alt)""")
on_cohort("tstv_by_qual", windows.ts_tv_by_quality, f""", q AS (SELECT qual, count_if(ts) AS t, count_if(NOT ts) AS v FROM snp WHERE qual IS NOT NULL GROUP BY qual),
  z AS (SELECT qual, coalesce(sum(t) OVER lo, 0)::BIGINT AS n_ts_lt, coalesce(sum(v) OVER lo, 0)::BIGINT AS n_tv_lt, coalesce(sum(t) OVER hi, 0)::BIGINT AS n_ts_gt, coalesce(sum(v) OVER hi, 0)::BIGINT AS n_tv_gt FROM q
    WINDOW lo AS (ORDER BY qual ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (ORDER BY qual ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT {R('qual')} AS qual, n_ts_lt, n_tv_lt, n_ts_gt, n_tv_gt, round(n_ts_lt / nullif(n_tv_lt, 0)::DOUBLE, 6) + 0.0 AS ratio_lt, round(n_ts_gt / nullif(n_tv_gt, 0)::DOUBLE, 6) + 0.0 AS ratio_gt FROM z""")
on_cohort("tajima_d", lambda c: windows.tajima_d(c, 10000), """, n AS (SELECT 2 * count(*) AS n FROM sample), a AS (SELECT n, list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / (i * i))) AS a2 FROM n),
  k AS (SELECT *, ((n + 1) / (3.0::DOUBLE * (n - 1)) - 1 / a1) / a1 AS e1, (2 * (n * n + n + 3) / (9.0::DOUBLE * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM a),
  b AS (SELECT chrom, pos // 10000 AS bin, count(*) AS s, sum(2 * (n_ref / (n_ref + n_alt)::DOUBLE) * (1 - n_ref / (n_ref + n_alt)::DOUBLE)) AS x FROM bi WHERE n_ref > 0 AND n_alt > 0 GROUP BY ALL),
  e AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY chrom)
  SELECT chrom, (bin * 10000)::BIGINT AS bin_start, coalesce(s, 0) AS n_snps, round((x * n / (n - 1) - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 6) + 0.0 AS tajima_d FROM e LEFT JOIN b USING (chrom, bin) CROSS JOIN k""")
on_cohort("window_pi", lambda c: windows.window_pi(c, 1000, 250), """, n AS (SELECT 2 * count(*) AS n FROM sample),
  w AS (SELECT chrom, n_ref + n_alt AS t, 2 * n_ref * n_alt AS m, unnest(range(greatest(0, ceil((pos - 1000) / 250.0)::INT), ceil(pos / 250.0)::INT)) AS k FROM bi WHERE n_ref < n_ref + n_alt)
  SELECT chrom, (k * 250 + 1)::BIGINT AS bin_start, (k * 250 + 1000)::BIGINT AS bin_end, count(*) AS n_variants, round(sum(m)::DOUBLE / (sum(t * (t - 1)) + (1000 - count(*)) * any_value(n) * (any_value(n) - 1))::DOUBLE, 6) + 0.0 AS pi FROM w CROSS JOIN n GROUP BY chrom, k""")
FST = """, c AS (SELECT c.site_id, c.sample_idx % 3 AS pop, a1, a2 FROM full_call c JOIN tot USING (site_id) WHERE diploid),
  sz AS (SELECT site_id, pop, count(*) AS n FROM c GROUP BY ALL), al AS (SELECT site_id, pop, a1 AS a, 1 AS k, a1 <> a2 AS het FROM c UNION ALL SELECT site_id, pop, a2, 1, a1 <> a2 FROM c),
  hd AS (SELECT site_id, pop, a, sum(k) AS copies, count_if(het) AS hets FROM al GROUP BY ALL),
  ev AS (SELECT x.site_id, x.a, s.pop, s.n, coalesce(copies, 0) AS copies, coalesce(hets, 0) AS hets FROM (SELECT DISTINCT site_id, a FROM hd) x JOIN sz s USING (site_id) LEFT JOIN hd USING (site_id, pop, a)),
  t AS (SELECT site_id, a, sum(n)::DOUBLE AS sn, sum(n * n)::DOUBLE AS sn2, sum(copies)::DOUBLE AS sc, sum(hets)::DOUBLE AS sh, sum(copies * copies / (4.0::DOUBLE * n)) AS sp2, count(*) AS pops FROM ev GROUP BY ALL),
  u AS (SELECT *, sn / 3 AS nbar, sc / (2 * sn) AS p, sh / sn AS h, (sp2 - sn * (sc / (2 * sn)) * (sc / (2 * sn))) / (2 * sn / 3) AS s2, (sn - sn2 / sn) / 2 AS nc FROM t WHERE pops = 3),
  v AS (SELECT *, p * (1 - p) - 2.0 / 3 * s2 AS i FROM u WHERE nbar > 1 AND nc <> 0),
  z AS (SELECT site_id, nbar / nc * (s2 - (i - h / 4) / (nbar - 1)) AS a, nbar / (nbar - 1) * (i - h * (2 * nbar - 1) / (4 * nbar)) AS b, h / 2 AS c FROM v),
  f AS (SELECT site_id, sum(a) AS a, sum(a + b + c) AS abc FROM z GROUP BY site_id), fs AS (SELECT s.chrom, s.pos, f.* FROM f JOIN site s USING (site_id))
"""
query("weir_fst", lambda s, d: windows.weir_fst(c := mapping.cohort(s, d), mapping.populations(c)), FST + "SELECT chrom, pos, CASE WHEN abs(abc) > 1e-12 THEN round(a / abc, 6) + 0.0 END AS fst FROM fs")
query("windowed_fst", lambda s, d: windows.windowed_fst(c := mapping.cohort(s, d), mapping.populations(c), 2000, 1000), FST + """, w AS (SELECT *, unnest(range(greatest(0, ceil((pos - 2000) / 1000.0)::INT), ceil(pos / 1000.0)::INT)) AS k FROM fs WHERE abs(abc) > 1e-12)
  SELECT chrom, (k * 1000 + 1)::BIGINT AS bin_start, (k * 1000 + 2000)::BIGINT AS bin_end, count(*) AS n_variants, CASE WHEN abs(sum(abc)) > 1e-12 THEN round(sum(a) / sum(abc), 6) + 0.0 END AS weighted_fst, round(avg(a / abc), 6) + 0.0 AS mean_fst FROM w GROUP BY chrom, k""")


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.intervals(spark, sf_dir).groupBy("chrom", F.floor(F.col("start") / 1000).alias("b")).agg(F.min("start").alias("start")).select("chrom", "start", (F.col("start") + 150).alias("end"))


query("hapcount", lambda s, d: windows.haplotype_counts(mapping.cohort(s, d), _bins(s, d)), """, b AS (SELECT chrom, min(start) AS start, min(start) + 150 AS "end" FROM iv GROUP BY chrom, start // 1000),
  s AS (SELECT * FROM bi WHERE all_phased), hit AS (SELECT s.site_id, s.pos, b.* FROM s JOIN b ON s.chrom = b.chrom AND b.start < s.pos AND s.pos <= b."end"),
  cp AS (SELECT c.site_id, sample_id, 1 AS k, a1 AS a FROM call c UNION ALL SELECT c.site_id, sample_id, 2, a2 FROM call c),
  h AS (SELECT hit.chrom, start, "end", sample_id, k, string_agg(coalesce(CAST(a AS VARCHAR), '.'), '' ORDER BY pos, hit.site_id) AS h FROM hit JOIN cp USING (site_id) GROUP BY ALL),
  z AS (SELECT chrom, start, "end", h, count(*) AS n FROM h GROUP BY ALL), gr AS (SELECT chrom, start, "end", n, count(*) AS k FROM z GROUP BY ALL), per AS (SELECT chrom, start, "end", CAST(sum(k) AS BIGINT) AS n_unique, max(n) AS largest, string_agg(n || ':' || k, ',' ORDER BY n DESC) AS groups FROM gr GROUP BY ALL), st AS (SELECT chrom, start, "end", count(*) AS n_snps FROM hit GROUP BY ALL)
  SELECT b.chrom, b.start, b."end", coalesce(n_snps, 0) AS n_snps, coalesce(n_unique, 0) AS n_unique, coalesce(largest, 0) AS largest, coalesce(groups, '') AS groups FROM b LEFT JOIN st USING (chrom, start, "end") LEFT JOIN per USING (chrom, start, "end") WHERE b.chrom IN (SELECT chrom FROM s)""")
on_cohort("indel_hist", windows.indel_lengths, """, x AS (SELECT ref, unnest(alt) AS b FROM site), y AS (SELECT length(b) - length(ref) AS length FROM x WHERE regexp_full_match(b, '[ACGTN]+') AND (length(b) <> length(ref) OR length(ref) = 1))
  SELECT CAST(length AS INT) AS length, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS percent FROM y GROUP BY length""")

# linkage disequilibrium
PAIRS = """, s AS (SELECT site_id, row_number() OVER (PARTITION BY chrom ORDER BY pos, site_id) AS rn FROM {src}),
  d AS ({rows}),
  j AS (SELECT a.chrom, a.pos AS pos_a, b.pos AS pos_b, a.site_id AS i, b.site_id AS k, a.x AS x, b.x AS y FROM d a JOIN d b ON a.chrom = b.chrom AND a.sample_id = b.sample_id AND {on})
"""
GENO = "SELECT c.site_id, c.chrom, c.pos, rn, sample_id, (a1 = 0)::INT + (a2 = 0)::INT AS x FROM full_call c JOIN s USING (site_id)"
HAPS = "SELECT c.site_id, c.chrom, c.pos, rn, sample_id || ':1' AS sample_id, (a1 = 0)::INT AS x FROM call c JOIN s USING (site_id) WHERE a1 IS NOT NULL UNION ALL SELECT c.site_id, c.chrom, c.pos, rn, sample_id || ':2', (a2 = 0)::INT FROM call c JOIN s USING (site_id) WHERE a2 IS NOT NULL"
PHASED = "(SELECT * FROM bi WHERE all_phased)"
SUMS = "count(*)::BIGINT AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * y)::BIGINT AS sxy, sum(x * x)::BIGINT AS sxx, sum(y * y)::BIGINT AS syy"
R2 = "CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) <> 0 THEN round((n * sxy - sx * sy)::DOUBLE * (n * sxy - sx * sy) / ((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)), 6) + 0.0 END"
DD = "(sxy / n::DOUBLE - sx / n::DOUBLE * (sy / n::DOUBLE))"
VAR = "sx <> 0 AND sx <> n AND sy <> 0 AND sy <> n"
HAP = f"""n AS n_chr, CASE WHEN {VAR} THEN round({DD} * {DD} / (sx / n::DOUBLE * (1 - sx / n::DOUBLE) * (sy / n::DOUBLE) * (1 - sy / n::DOUBLE)), 6) + 0.0 END AS r2,
  CASE WHEN sxy * n = sx * sy THEN 0.0 ELSE round({DD}, 6) + 0.0 END AS d,
  CASE WHEN {VAR} THEN CASE WHEN sxy * n = sx * sy THEN 0.0 ELSE round({DD} / CASE WHEN {DD} < 0 THEN least(sx / n::DOUBLE * (sy / n::DOUBLE), (1 - sx / n::DOUBLE) * (1 - sy / n::DOUBLE)) ELSE least(sx / n::DOUBLE * (1 - sy / n::DOUBLE), (1 - sx / n::DOUBLE) * (sy / n::DOUBLE)) END, 6) + 0.0 END END AS d_prime"""
NEAR = "b.rn > a.rn AND b.pos - a.pos <= {bp} AND b.pos >= a.pos"


def _pairs(src: str, rows: str, on: str) -> str:
    return PAIRS.format(src=src, rows=rows, on=on)


on_cohort("geno_r2", lambda c: ld.genotype_r2(c, 500), _pairs("bi", GENO, NEAR.format(bp=500)) + f", z AS (SELECT chrom, pos_a, pos_b, i, k, {SUMS} FROM j GROUP BY ALL) SELECT chrom, pos_a, pos_b, n AS n_indv, {R2} AS r2 FROM z")
on_cohort("geno_r2_min", lambda c: ld.genotype_r2(c, 500, bp_min=50, sites=3, sites_min=2, min_r2=0.1), _pairs("bi", GENO, NEAR.format(bp=500) + " AND b.pos - a.pos >= 50 AND b.rn - a.rn BETWEEN 2 AND 3") + f", z AS (SELECT chrom, pos_a, pos_b, i, k, {SUMS} FROM j GROUP BY ALL) SELECT * FROM (SELECT chrom, pos_a, pos_b, n AS n_indv, {R2} AS r2 FROM z) WHERE r2 >= 0.1")
on_cohort("hap_r2", lambda c: ld.haplotype_r2(c, 500), _pairs(PHASED, HAPS, NEAR.format(bp=500)) + f", z AS (SELECT chrom, pos_a, pos_b, i, k, {SUMS} FROM j GROUP BY ALL) SELECT chrom, pos_a, pos_b, {HAP} FROM z")
CHI_ROWS = "SELECT c.site_id, c.chrom, c.pos, rn, sample_id, least(a1, a2) * 1000 + greatest(a1, a2) AS x FROM full_call c JOIN s USING (site_id)"
on_cohort("geno_chisq", lambda c: ld.genotype_chisq(c, 200).drop("p_value"), _pairs("(SELECT * FROM site WHERE len(alt) > 0)", CHI_ROWS, NEAR.format(bp=200)) + """, cell AS (SELECT chrom, pos_a, pos_b, i, k, x, y, count(*) AS o FROM j GROUP BY ALL),
  m AS (SELECT *, sum(o) OVER (PARTITION BY i, k) AS n, sum(o) OVER (PARTITION BY i, k, x) AS ra, sum(o) OVER (PARTITION BY i, k, y) AS rb FROM cell)
  SELECT chrom, pos_a, pos_b, any_value(n)::BIGINT AS n_indv, round(greatest(0.0, any_value(n) * (sum(o * o / (ra::DOUBLE * rb::DOUBLE)) - 1)), 6) + 0.0 AS chisq, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM m GROUP BY chrom, pos_a, pos_b, i, k""")
on_cohort("geno_chisq_p", lambda c: ld.genotype_chisq(c, 100))


ACROSS = """, s AS (SELECT site_id, 0 AS rn FROM {src}), d AS ({rows}), j AS (SELECT a.chrom AS chrom_a, a.pos AS pos_a, b.chrom AS chrom_b, b.pos AS pos_b, a.site_id AS i, b.site_id AS k, a.x, b.x AS y FROM d a JOIN d b ON a.sample_id = b.sample_id AND a.chrom < b.chrom),
  z AS (SELECT chrom_a, pos_a, chrom_b, pos_b, i, k, {sums} FROM j GROUP BY ALL) SELECT * FROM (SELECT chrom_a, pos_a, chrom_b, pos_b, {out} FROM z) WHERE r2 >= 0.2037"""
on_cohort("interchrom_geno_r2", lambda c: ld.genotype_r2_across(c, 0.2037), ACROSS.format(src="bi", rows=GENO, sums=SUMS, out=f"n AS n_indv, {R2} AS r2"))
on_cohort("interchrom_hap_r2", lambda c: ld.haplotype_r2_across(c, 0.2037), ACROSS.format(src=PHASED, rows=HAPS, sums=SUMS, out=HAP))
LISTED = """, s AS (SELECT site_id, 0 AS rn FROM {src}), d AS ({rows}), j AS (SELECT a.chrom, a.pos AS pos_a, b.pos AS pos_b, a.site_id AS i, b.site_id AS k, a.x, b.x AS y FROM d a JOIN d b ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 400
    WHERE a.site_id % 50 = 0 AND b.site_id % 50 <> 0),
  z AS (SELECT chrom, pos_a, pos_b, i, k, {sums} FROM j GROUP BY ALL) SELECT chrom, pos_a, pos_b, {out} FROM z"""


def _positions(c) -> DataFrame:
    return c.sites.filter("site_id % 50 = 0").select("chrom", "pos")


on_cohort("geno_r2_positions", lambda c: ld.genotype_r2_listed(c, _positions(c), 400), LISTED.format(src="bi", rows=GENO, sums=SUMS, out=f"n AS n_indv, {R2} AS r2"))
on_cohort("hap_r2_positions", lambda c: ld.haplotype_r2_listed(c, _positions(c), 400), LISTED.format(src=PHASED, rows=HAPS, sums=SUMS, out=HAP))

# two cohorts
both = lambda name, make, sql: query(name, lambda s, d: make(mapping.first(s, d), mapping.second(s, d)), sql)
both("diff_site", compare.sites, """SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, CASE WHEN b.ref IS NULL THEN '1' WHEN a.ref IS NULL THEN '2' WHEN a.ref = b.ref THEN 'B' ELSE 'O' END AS files,
  a.ref AS ref_1, b.ref AS ref_2, array_to_string(a.alt, ',') AS alt_1, array_to_string(b.alt, ',') AS alt_2 FROM one a FULL JOIN two b ON a.chrom = b.chrom AND a.pos = b.pos""")
both("diff_indv", lambda a, b: compare.samples(filters.remove_samples(a, a.samples.filter("sample_idx = 0")), filters.remove_samples(b, b.samples.filter("sample_idx = 1"))), """
  SELECT sample_id, CASE sample_idx WHEN 0 THEN '2' WHEN 1 THEN '1' ELSE 'B' END AS files FROM sample""")
both("diff_indv_map", lambda a, b: compare.samples(a, b.with_(samples=b.samples.withColumn("sample_id", F.concat(F.lit("X"), "sample_id"))), a.samples.filter("sample_idx % 2 = 0").select(F.col("sample_id").alias("id_1"), F.concat(F.lit("X"), "sample_id").alias("id_2"))), """
  SELECT sample_id, CASE WHEN sample_idx % 2 = 0 THEN 'B' ELSE '1' END AS files FROM sample UNION ALL SELECT 'X' || sample_id, '2' FROM sample WHERE sample_idx % 2 = 1""")
both("diff_indv_discordance", compare.discordance_by_sample, "SELECT *, round(n_discord / nullif(n_common_called, 0)::DOUBLE, 6) + 0.0 AS discordance FROM (SELECT sample_id, count_if(both_called) AS n_common_called, count_if(both_called AND NOT equal) AS n_discord FROM same GROUP BY ALL)")
both("diff_site_discordance", compare.discordance_by_site, """, p AS (SELECT chrom, pos, count_if(both_called) AS n, count_if(both_called AND NOT equal) AS k, any_value(alts_1 = alts_2) AS m FROM same GROUP BY ALL),
  f AS (SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, CASE WHEN b.ref IS NULL THEN '1' WHEN a.ref IS NULL THEN '2' WHEN a.ref = b.ref THEN 'B' ELSE 'O' END AS files FROM one a FULL JOIN two b ON a.chrom = b.chrom AND a.pos = b.pos)
  SELECT chrom, pos, files, coalesce(m, false) AS matching_alleles, coalesce(n, 0) AS n_common_called, coalesce(k, 0) AS n_discord, round(k / nullif(n, 0)::DOUBLE, 6) + 0.0 AS discordance FROM f LEFT JOIN p USING (chrom, pos)""")
both("diff_discordance_matrix", compare.discordance_matrix, """, g AS (SELECT CASE WHEN x1 IS NULL AND y1 IS NULL THEN './.' WHEN x1 IS NOT NULL AND y1 IS NOT NULL THEN least(i1, j1) || '/' || greatest(i1, j1) END AS gt_1,
  CASE WHEN x2 IS NULL AND y2 IS NULL THEN './.' WHEN x2 IS NOT NULL AND y2 IS NOT NULL THEN least(i2, j2) || '/' || greatest(i2, j2) END AS gt_2 FROM same WHERE alts_1 = alts_2 AND alts_1 <> '.' AND alts_1 NOT LIKE '%,%')
  SELECT gt_1, gt_2, count(*) AS n FROM g WHERE gt_1 IS NOT NULL AND gt_2 IS NOT NULL GROUP BY ALL""")
both("diff_switch_error", compare.switch_errors, """, h AS (SELECT *, x1 = x2 AS eq FROM same WHERE both_called AND equal AND phased_1 AND phased_2 AND x1 <> y1),
  l AS (SELECT *, lag(eq) OVER w AS was, lag(pos) OVER w AS start FROM h WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos)) SELECT chrom, start, pos AS "end", sample_id FROM l WHERE was <> eq""")
both("diff_switch_summary", compare.switch_summary, """, h AS (SELECT *, x1 = x2 AS eq FROM same WHERE both_called AND equal AND phased_1 AND phased_2 AND x1 <> y1),
  l AS (SELECT *, lag(eq) OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS was FROM h), n AS (SELECT sample_id, count(*) AS n_het, count_if(was <> eq) AS n_switch FROM l GROUP BY ALL)
  SELECT sample_id, coalesce(n_het, 0) AS n_het, coalesce(n_switch, 0) AS n_switch, round(coalesce(n_switch::DOUBLE / nullif(n_het, 0)::DOUBLE, 0), 6) + 0.0 AS rate FROM sample LEFT JOIN n USING (sample_id)""")

# filters: each one alone, as the sites it keeps
def kept(name: str, make: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = mapping.cohort(spark, sf_dir)
        f = make(c, spark, sf_dir) if callable(make) else make
        return filters.apply(c, f).sites.select("site_id", "chrom", "pos")

    query(f"filter_{name}", run, sql)


ON = "SELECT site_id, chrom, pos FROM site WHERE "
INDEL = "(length(ref) <> 1 OR len(list_filter(alt, lambda x: length(x) <> length(ref))) > 0)"
kept("keep_only_indels", Filters(indels=True), ON + INDEL)
kept("remove_indels", Filters(indels=False), ON + "NOT " + INDEL)
kept("snps", Filters(ids=("rs5", "rs10", "rs40")), ON + "id IN ('rs5', 'rs10', 'rs40')")
kept("exclude", Filters(exclude_ids=("rs5", "rs10", "rs40")), ON + "coalesce(id NOT IN ('rs5', 'rs10', 'rs40'), true)")
kept("keep_filtered", Filters(keep_filtered=("q10", "PASS")), ON + "list_has_any(filter, ['q10', 'PASS'])")
kept("remove_filtered_all", Filters(remove_filtered_all=True), ON + "len(filter) = 0 OR filter[1] = 'PASS'")
kept("remove_filtered", Filters(remove_filtered=("q10",)), ON + "len(filter) = 0 OR filter[1] = 'PASS' OR NOT list_has_any(filter, ['q10'])")
kept("region", Filters(chrom=("chr2",), from_bp=500, to_bp=9000), ON + "chrom = 'chr2' AND pos BETWEEN 500 AND 9000")
kept("not_chr", Filters(not_chrom=("chr1", "chr3")), ON + "chrom NOT IN ('chr1', 'chr3')")
kept("positions", lambda c, s, d: Filters(positions=_positions(c)), ON + "site_id % 50 = 0")
kept("exclude_positions", lambda c, s, d: Filters(exclude_positions=_positions(c)), ON + "site_id % 50 <> 0")
SHIFTED = "SELECT chrom, pos + 1 AS pos FROM site WHERE site_id % 3 = 0"
shifted = lambda c: c.sites.filter("site_id % 3 = 0").selectExpr("chrom", "pos + 1 AS pos")
OVER = f"EXISTS (SELECT 1 FROM ({SHIFTED}) p WHERE p.chrom = site.chrom AND p.pos >= site.pos AND p.pos < site.pos + length(ref))"
kept("positions_overlap", lambda c, s, d: Filters(positions_overlap=shifted(c)), ON + OVER)
kept("exclude_positions_overlap", lambda c, s, d: Filters(exclude_positions_overlap=shifted(c)), ON + "NOT " + OVER)
BED = 'EXISTS (SELECT 1 FROM iv WHERE iv.chrom = site.chrom AND iv.start < site.pos + greatest(length(ref), coalesce(list_max(list_transform(alt, lambda x: length(x))), 1)) - 1 AND iv."end" >= site.pos)'
kept("bed", lambda c, s, d: Filters(bed=mapping.intervals(s, d)), ON + BED)
kept("exclude_bed", lambda c, s, d: Filters(exclude_bed=mapping.intervals(s, d)), ON + "NOT " + BED)
kept("alleles", Filters(min_alleles=2, max_alleles=2), ON + "len(alt) = 1")
kept("keep_info", Filters(keep_info=("DB",)), ON + "db")
kept("remove_info", Filters(remove_info=("DB",)), ON + "NOT db")
kept("min_q", Filters(min_q=40.0), ON + "coalesce(qual, -1) >= 40")
MEAN = "SELECT site_id FROM call GROUP BY site_id HAVING "
kept("mean_dp", Filters(min_mean_dp=15.0, max_mean_dp=25.0), ON + f"site_id IN ({MEAN} sum(coalesce(dp, 0)) / count(*)::DOUBLE BETWEEN 15 AND 25)")
kept("phased", Filters(phased=True), ON + f"site_id IN ({MEAN} bool_and(phased))")
FRQ = "SELECT site_id FROM (SELECT *, count / nullif(n_called, 0)::DOUBLE AS f FROM allele) GROUP BY site_id HAVING "
kept("maf", Filters(maf=0.2, max_maf=0.45), ON + f"site_id IN ({FRQ} min(least(f, 1 - f)) BETWEEN 0.2 AND 0.45)")
kept("non_ref_af", Filters(non_ref_af=0.2, max_non_ref_af=0.5), ON + f"site_id IN ({FRQ} coalesce(bool_and(CASE WHEN allele_idx > 0 THEN f BETWEEN 0.2 AND 0.5 END), true))")
kept("non_ref_af_any", Filters(non_ref_af_any=0.35), ON + f"site_id IN ({FRQ} coalesce(bool_or(CASE WHEN allele_idx > 0 THEN f >= 0.35 END), false))")
kept("mac", Filters(mac=8, max_mac=14), ON + f"site_id IN ({FRQ} min(least(count, n_called - count)) BETWEEN 8 AND 14)")
kept("non_ref_ac", Filters(non_ref_ac=8, max_non_ref_ac=20), ON + f"site_id IN ({FRQ} coalesce(bool_and(CASE WHEN allele_idx > 0 THEN count BETWEEN 8 AND 20 END), true))")
kept("non_ref_ac_any", Filters(non_ref_ac_any=12), ON + f"site_id IN ({FRQ} coalesce(bool_or(CASE WHEN allele_idx > 0 THEN count >= 12 END), false))")
kept("max_missing", Filters(max_missing=0.8), ON + "site_id IN (SELECT site_id FROM tot WHERE n_called >= 0.8 * n_chr)")
kept("max_missing_count", Filters(max_missing_count=6), ON + "site_id IN (SELECT site_id FROM tot WHERE n_chr - n_called <= 6)")
kept("thin", Filters(thin=300), """SELECT site_id, chrom, pos FROM (WITH RECURSIVE r AS (SELECT chrom, min(pos) AS pos FROM site GROUP BY chrom
  UNION ALL SELECT chrom, (SELECT min(s.pos) FROM site s WHERE s.chrom = r.chrom AND s.pos >= r.pos + 300) FROM r WHERE r.pos IS NOT NULL) SELECT site_id, site.chrom, site.pos FROM r JOIN site ON site.chrom = r.chrom AND site.pos = r.pos)""")
kept("hwe", Filters(hwe=0.05), """, g AS (SELECT *, r + h + a AS n, 2 * least(r, a) + h AS rare FROM bia), k AS (SELECT g.*, unnest(range((rare % 2)::BIGINT, (rare + 1)::BIGINT, 2)) AS k FROM g),
  w AS (SELECT *, k * ln(2.0) - lgamma(k + 1) - lgamma((rare - k) // 2 + 1) - lgamma(n - k - (rare - k) // 2 + 1) AS lw FROM k), w2 AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY site_id)) AS x FROM w),
  w3 AS (SELECT *, max(CASE WHEN k = h THEN x END) OVER (PARTITION BY site_id) AS seen FROM w2), p AS (SELECT site_id, sum(x) FILTER (x <= seen * (1 + 1e-9)) / sum(x) AS p FROM w3 GROUP BY site_id)
  SELECT site_id, chrom, pos FROM site WHERE site_id IN (SELECT site_id FROM p WHERE p >= 0.05)""")
on_cohort("mask_calls", lambda c: site.frequencies(filters.apply(c, Filters(min_gq=20.0, min_dp=5, max_dp=45, remove_filtered_geno_all=True))), f""", m AS (SELECT site_id, sample_id, a FROM copies JOIN (SELECT site_id, sample_id FROM call WHERE gq >= 20 AND dp BETWEEN 5 AND 45) USING (site_id, sample_id)),
  k AS (SELECT site_id, count(*) AS n_called FROM m GROUP BY site_id), c AS (SELECT site_id, a, count(*) AS n FROM m GROUP BY ALL)
  SELECT chrom, pos, allele_idx, allele, n_chr, coalesce(k.n_called, 0) AS n_called, coalesce(c.n, 0) AS count, round(coalesce(c.n, 0) / nullif(k.n_called, 0)::DOUBLE, 6) + 0.0 AS freq FROM allele LEFT JOIN k USING (site_id) LEFT JOIN c ON c.site_id = allele.site_id AND c.a = allele_idx""")
on_cohort("mask_flagged_calls", lambda c: site.frequencies(filters.apply(c, Filters(remove_filtered_geno=("q20",)))), f""", m AS (SELECT site_id, a FROM copies JOIN (SELECT site_id, sample_id FROM call WHERE gq >= 20) USING (site_id, sample_id)),
  k AS (SELECT site_id, count(*) AS n_called FROM m GROUP BY site_id), c AS (SELECT site_id, a, count(*) AS n FROM m GROUP BY ALL)
  SELECT chrom, pos, allele_idx, allele, n_chr, coalesce(k.n_called, 0) AS n_called, coalesce(c.n, 0) AS count, round(coalesce(c.n, 0) / nullif(k.n_called, 0)::DOUBLE, 6) + 0.0 AS freq FROM allele LEFT JOIN k USING (site_id) LEFT JOIN c ON c.site_id = allele.site_id AND c.a = allele_idx""")
DIGIT = "CAST(pos * 7 % 11 % 4 AS INT)"
kept("mask", lambda c, s, d: Filters(mask=_digits(s, d), mask_min=1), ON + DIGIT + " <= 1")
kept("invert_mask", lambda c, s, d: Filters(mask=_digits(s, d), mask_min=1, invert_mask=True), ON + DIGIT + " > 1")
on_cohort("kept_sites", lambda c: filters.apply(c, Filters(min_alleles=2, max_alleles=2, maf=0.2)).sites.select("chrom", "pos"), f"SELECT chrom, pos FROM site WHERE len(alt) = 1 AND site_id IN ({FRQ} min(least(f, 1 - f)) >= 0.2)")
on_cohort("removed_sites", lambda c: site.removed(c, filters.apply(c, Filters(min_alleles=2, max_alleles=2, maf=0.2))), f"SELECT chrom, pos FROM site WHERE NOT (len(alt) = 1 AND site_id IN ({FRQ} min(least(f, 1 - f)) >= 0.2))")
on_cohort("keep_samples", lambda c: individual.depth(filters.remove_samples(filters.keep_samples(c, c.samples.filter("sample_idx < 12")), c.samples.filter("sample_idx % 5 = 0"))), "SELECT sample_id, count(dp) AS n_sites, round(sum(dp) / count(dp)::DOUBLE, 6) + 0.0 AS mean_depth FROM call WHERE sample_idx < 12 AND sample_idx % 5 <> 0 GROUP BY sample_id")
on_cohort("max_samples", lambda c: filters.draw_samples(c, 5).samples, "SELECT sample_id, sample_idx FROM sample ORDER BY md5('0:' || sample_id), sample_id LIMIT 5")



def _digits(s: SparkSession, d: str) -> DataFrame:
    """A made-up mask: the made-up reference with digits for its bases."""
    return _reference(s, d).select("chrom", "start", F.translate("seq", "ACGT", "0123").alias("digits"))


# several inputs
THREE = """, i1 AS (SELECT * FROM site WHERE site_id % 7 <> 0), i2 AS (SELECT * FROM site WHERE site_id % 6 <> 0), i3 AS (SELECT * FROM site WHERE site_id % 4 <> 0),
  u AS (SELECT *, 1 AS src, 10 AS w FROM i1 UNION ALL SELECT *, 2, 20 FROM i2 UNION ALL SELECT *, 3, 20 FROM i3)
"""


def _three(s: SparkSession, d: str) -> list:
    c = mapping.cohort(s, d)
    return [c.with_(sites=c.sites.filter(f"site_id % {m} <> 0")) for m in (7, 6, 4)]


ISEC = """, p AS (SELECT chrom, pos, array_to_string(list_sort(list(DISTINCT src - 1)), ',') AS sf, count(DISTINCT src) AS n, min(src) AS first FROM u GROUP BY ALL)
  SELECT u.chrom, u.pos, ref, array_to_string(alt, ',') AS alt, src, sf FROM u JOIN p ON u.chrom = p.chrom AND u.pos = p.pos WHERE src = first AND """
query("isec_at_least", lambda s, d: sets.intersect(_three(s, d), least=2), THREE + ISEC + "n >= 2")
query("isec_exactly", lambda s, d: sets.intersect(_three(s, d), exactly=2), THREE + ISEC + "n = 2")
query("isec_at_most", lambda s, d: sets.intersect(_three(s, d), most=1, passed_only=True), THREE.replace("FROM i1", "FROM i1 WHERE len(filter) = 0 OR filter[1] = 'PASS'").replace("FROM i2", "FROM i2 WHERE len(filter) = 0 OR filter[1] = 'PASS'").replace("FROM i3", "FROM i3 WHERE len(filter) = 0 OR filter[1] = 'PASS'") + ISEC + "n <= 1")
query("isec_window", lambda s, d: sets.intersect(_three(s, d), least=3, gap=5, first_only=True), THREE + """, l AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 5 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM u WINDOW w AS (PARTITION BY chrom ORDER BY pos, src)),
  k AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos, src ROWS UNBOUNDED PRECEDING) AS cluster FROM l), p AS (SELECT chrom, cluster, array_to_string(list_sort(list(DISTINCT src - 1)), ',') AS sf, count(DISTINCT src) AS n FROM k GROUP BY ALL)
  SELECT k.chrom, k.pos, ref, array_to_string(alt, ',') AS alt, src, sf FROM k JOIN p ON k.chrom = p.chrom AND k.cluster = p.cluster WHERE n >= 3 AND src = 1""")
query("isec_complement", lambda s, d: sets.complement(_three(s, d)[0], _three(s, d)[1:]), THREE + "SELECT chrom, pos, ref, array_to_string(alt, ',') AS alt FROM i1 WHERE NOT EXISTS (SELECT 1 FROM i2 WHERE i2.chrom = i1.chrom AND i2.pos = i1.pos) AND NOT EXISTS (SELECT 1 FROM i3 WHERE i3.chrom = i1.chrom AND i3.pos = i1.pos)")
query("compare_venn", lambda s, d: sets.venn(_three(s, d)), THREE + "SELECT files, count(*) AS n_sites FROM (SELECT chrom, pos, array_to_string(list_sort(list(DISTINCT src)), ',') AS files FROM u GROUP BY ALL) GROUP BY files")
query("concat", lambda s, d: sets.concat(_three(s, d)).select("chrom", "pos", "ref", "src"), THREE + "SELECT chrom, pos, ref, src FROM u")
query("merge", lambda s, d: sets.merge([mapping.first(s, d), mapping.second(s, d)]), """, u AS (SELECT *, 1 AS src FROM one UNION ALL SELECT *, 2 FROM two), lr AS (SELECT chrom, pos, arg_max(ref, length(ref) * 10 - src) AS mr FROM u GROUP BY ALL),
  x AS (SELECT u.*, mr, list_transform(alt, lambda a: a || substr(mr, length(ref) + 1)) AS alts FROM u JOIN lr ON u.chrom = lr.chrom AND u.pos = lr.pos),
  g AS (SELECT chrom, pos, mr, flatten(list(alts ORDER BY src)) AS al, flatten(list(filter ORDER BY src)) AS fl, avg(qual) AS qual, string_agg(CAST(src - 1 AS VARCHAR), ',' ORDER BY src) AS sf, coalesce(nullif(concat_ws(';', 'AA=' || any_value(aa), CASE WHEN bool_or(db) THEN 'DB=1' END), ''), '.') AS info FROM x GROUP BY ALL)
  SELECT chrom, pos, info, mr AS ref, array_to_string(list_filter(al, lambda v, i: list_position(al, v) = i), ',') AS alt, round(qual, 6) + 0.0 AS qual, array_to_string(list_sort(list_distinct(list_filter(fl, lambda f: f <> 'PASS'))), ';') AS filter, sf FROM g""")
query("merge_genotypes", lambda s, d: sets.merge_records([mapping.first(s, d), mapping.second(s, d)]), """, u AS (SELECT *, 1 AS src FROM one UNION ALL SELECT *, 2 FROM two), lr AS (SELECT chrom, pos, arg_max(ref, length(ref) * 10 - src) AS mr FROM u GROUP BY ALL),
  x AS (SELECT u.*, mr, list_transform(alt, lambda a: a || substr(mr, length(ref) + 1)) AS alts FROM u JOIN lr ON u.chrom = lr.chrom AND u.pos = lr.pos),
  g AS (SELECT chrom, pos, mr, flatten(list(alts ORDER BY src)) AS al, coalesce(nullif(concat_ws(';', 'AA=' || any_value(aa), CASE WHEN bool_or(db) THEN 'DB=1' END), ''), '.') AS info FROM x GROUP BY ALL),
  m AS (SELECT chrom, pos, mr, info, list_filter(al, lambda v, i: list_position(al, v) = i) AS al FROM g),
  cc AS (SELECT 1 AS src, site_id, sample_id, a1, a2, ploidy, phased FROM call1 UNION ALL SELECT 2, site_id, sample_id, a1, a2, ploidy, phased FROM call2),
  n AS (SELECT x.chrom, x.pos, cc.src || '_' || sample_id AS name, ploidy, cc.phased, CASE WHEN a1 = 0 THEN 0 WHEN a1 <= len(alts) THEN list_position(m.al, alts[a1]) END AS b1, CASE WHEN a2 = 0 THEN 0 WHEN a2 <= len(alts) THEN list_position(m.al, alts[a2]) END AS b2
    FROM cc JOIN x ON cc.src = x.src AND cc.site_id = x.site_id JOIN m ON m.chrom = x.chrom AND m.pos = x.pos),
  t AS (SELECT *, name || '=' || CASE WHEN ploidy = 1 THEN coalesce(CAST(b1 AS VARCHAR), '.') ELSE coalesce(CAST(b1 AS VARCHAR), '.') || CASE WHEN phased THEN '|' ELSE '/' END || coalesce(CAST(b2 AS VARCHAR), '.') END AS gt FROM n),
  c AS (SELECT chrom, pos, CAST(count(b1) + count(b2) AS INT) AS an, coalesce(string_agg(gt, ' ' ORDER BY name) FILTER (b1 IS NOT NULL OR b2 IS NOT NULL), '') AS genotypes, flatten(list([b1, b2])) AS every FROM t GROUP BY ALL)
  SELECT m.chrom, m.pos, mr AS ref, array_to_string(al, ',') AS alt, info, coalesce(an, 0) AS an, coalesce(array_to_string(list_transform(range(1, len(al) + 1), lambda i: len(list_filter(every, lambda b: b = i))), ','), '') AS ac, coalesce(genotypes, '') AS genotypes
  FROM m LEFT JOIN c ON c.chrom = m.chrom AND c.pos = m.pos""")
both("compare_genotypes", sets.genotype_agreement, """SELECT CASE WHEN i1 = 0 AND j1 = 0 THEN 'hom_RR' WHEN i1 = 0 OR j1 = 0 THEN 'het_RA' WHEN i1 = j1 THEN 'hom_AA' ELSE 'het_AA' END AS kind,
  count_if(both_called AND equal) AS n_match, count_if(both_called AND NOT equal) AS n_mismatch, count_if(NOT both_called) AS n_lost FROM same WHERE x1 IS NOT NULL AND y1 IS NOT NULL GROUP BY 1""")

# records
query("annotate", lambda s, d: records.annotate(mapping.cohort(s, d), mapping.intervals(s, d), "GENE", "end").select("chrom", "pos", records.info_text(F.col("info")).alias("info")), """, v AS (SELECT site_id, array_to_string(list_sort(list(DISTINCT CAST(iv."end" AS VARCHAR))), ',') AS v FROM site JOIN iv ON iv.chrom = site.chrom AND iv.start < pos AND iv."end" >= pos GROUP BY site_id)
  SELECT chrom, pos, CASE WHEN aa IS NULL AND NOT db AND v IS NULL THEN '.' ELSE concat_ws(';', 'AA=' || aa, CASE WHEN db THEN 'DB=1' END, 'GENE=' || v) END AS info FROM site LEFT JOIN v USING (site_id)""")
on_cohort("fill_an_ac", records.fill_counts, "SELECT chrom, pos, any_value(n_called) AS an, coalesce(string_agg(CAST(count AS VARCHAR), ',' ORDER BY allele_idx) FILTER (allele_idx > 0), '') AS ac FROM allele GROUP BY site_id, chrom, pos")
on_cohort("fill_hwe_icf", lambda c: records.fill_statistics(c).select("chrom", "pos", "icf"), "SELECT chrom, pos, round(1 - h / nullif(2 * p * (1 - p) * n, 0), 6) + 0.0 AS icf FROM (SELECT *, r + h + a AS n, (2 * r + h) / (2.0::DOUBLE * (r + h + a)) AS p FROM bi WHERE r + h + a > 0)")
on_cohort("fill_hwe", lambda c: records.fill_statistics(c).select("chrom", "pos", "hwe"), """, g AS (SELECT *, r + h + a AS n, 2 * least(r, a) + h AS rare FROM bi WHERE r + h + a > 0), k AS (SELECT g.*, unnest(range((rare % 2)::BIGINT, (rare + 1)::BIGINT, 2)) AS k FROM g),
  w AS (SELECT *, k * ln(2.0) - lgamma(k + 1) - lgamma((rare - k) // 2 + 1) - lgamma(n - k - (rare - k) // 2 + 1) AS lw FROM k), w2 AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY site_id)) AS x FROM w),
  w3 AS (SELECT *, max(CASE WHEN k = h THEN x END) OVER (PARTITION BY site_id) AS seen FROM w2), p AS (SELECT site_id, sum(x) FILTER (x <= seen * (1 + 1e-9)) / sum(x) AS p FROM w3 GROUP BY site_id)
  SELECT chrom, pos, round(p, 6) + 0.0 AS hwe FROM p JOIN site USING (site_id)""")
TYPE = "CASE WHEN b = ref THEN 'r' WHEN length(b) = length(ref) THEN 's' WHEN starts_with(b, ref) OR starts_with(ref, b) OR ends_with(b, ref) OR ends_with(ref, b) THEN 'i' ELSE 'o' END"
on_cohort("fill_type", records.fill_type, f"SELECT chrom, pos, ref, b AS alt, {TYPE} AS type FROM (SELECT *, unnest(alt) AS b FROM site)")
on_cohort("named_filters", lambda c: records.named_filters(c.sites, {"LowQual": F.col("qual") < 40, "RefN": F.contains("ref", F.lit("N")), "Even": F.col("pos") % 2 == 0}).select("chrom", "pos", F.array_join("filter", ";").alias("filter")), """, x AS (SELECT chrom, pos, list_sort(list_distinct(list_concat(list_filter(filter, lambda f: f <> 'PASS'), CASE WHEN qual < 40 THEN ['LowQual'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN pos % 2 = 0 THEN ['Even'] ELSE CAST([] AS VARCHAR[]) END))) AS f FROM site)
  SELECT chrom, pos, CASE WHEN len(f) = 0 THEN 'PASS' ELSE array_to_string(f, ';') END AS filter FROM x""")
IND = "(length(ref) <> 1 OR len(list_filter(alt, lambda x: length(x) <> length(ref))) > 0) AND len(alt) > 0"
SNP = "length(ref) = 1 AND len(alt) > 0 AND len(list_filter(alt, lambda x: length(x) <> 1)) = 0"
on_cohort("snp_gap", lambda c: records.snp_gap(c, 10), f"SELECT chrom, pos FROM site s WHERE {SNP} AND EXISTS (SELECT 1 FROM (SELECT * FROM site WHERE {IND}) i WHERE i.chrom = s.chrom AND s.pos > i.pos - 11 AND s.pos <= i.pos + length(i.ref) - 1 + 10)")
on_cohort("gap_window", lambda c: records.gap_window(c, 200), f""", af AS (SELECT site_id, max(count / greatest(n_called, 1)::DOUBLE) AS af FROM allele WHERE allele_idx > 0 GROUP BY site_id), i AS (SELECT * FROM site JOIN af USING (site_id) WHERE {IND}),
  l AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 200 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM i WINDOW w AS (PARTITION BY chrom ORDER BY pos, site_id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos, site_id) AS run FROM l)
  SELECT chrom, pos FROM (SELECT *, row_number() OVER (PARTITION BY chrom, run ORDER BY af DESC, pos, site_id) AS k FROM r) WHERE k > 1""")
on_cohort("snp_cluster", lambda c: records.snp_cluster(c, 3, 150), f""", s AS (SELECT *, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 149 FOLLOWING) AS ahead FROM site WHERE {SNP}),
  m AS (SELECT *, max(ahead) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 149 PRECEDING AND CURRENT ROW) AS most FROM s) SELECT chrom, pos FROM m WHERE most >= 3""")
CARRY = ", car AS (SELECT site_id, a, count_if(sample_idx < 4) AS own, count_if(sample_idx >= 4) AS other FROM copies WHERE a > 0 GROUP BY ALL)\n"
on_cohort("subset", lambda c: records.subset(c, c.samples.filter("sample_idx < 4"), exclude_reference=True, trim=True), CARRY + "SELECT s.chrom, s.pos, s.ref, array_to_string(list_transform(k, lambda i: s.alt[i]), ',') AS alt FROM site s JOIN (SELECT site_id, list_sort(list(a)) AS k FROM car WHERE own > 0 GROUP BY site_id) USING (site_id)")
on_cohort("subset_private", lambda c: records.subset(c, c.samples.filter("sample_idx < 4"), private=True), CARRY + "SELECT chrom, pos, ref, array_to_string(alt, ',') AS alt FROM site WHERE site_id IN (SELECT site_id FROM car WHERE own > 0 AND other = 0)")
on_cohort("subset_types", lambda c: records.subset(c, c.samples.filter("sample_idx < 4"), types=("i",)), f"SELECT chrom, pos, ref, array_to_string(alt, ',') AS alt FROM site WHERE site_id IN (SELECT site_id FROM (SELECT *, unnest(alt) AS b FROM site) WHERE {TYPE} = 'i')")
on_cohort("contrast", lambda c: records.contrast(c, ["S00", "S01"], ["S02", "S03", "S04"], 10), """, t AS (SELECT site_id FROM call WHERE sample_idx BETWEEN 2 AND 4 GROUP BY site_id HAVING min(coalesce(dp, 0)) >= 10 AND count(coalesce(a1, a2)) > 0),
  x AS (SELECT c.site_id, c.a, c.sample_id, c.sample_idx FROM copies c JOIN t USING (site_id) WHERE c.sample_idx < 5),
  g AS (SELECT site_id, a, count_if(sample_idx > 1) AS n, array_to_string(list_sort(list(DISTINCT sample_id) FILTER (sample_idx <= 1)), ',') AS carriers FROM x GROUP BY ALL)
  SELECT chrom, pos, coalesce(list_concat([ref], alt)[a + 1], '.') AS novel, carriers FROM g JOIN site USING (site_id) WHERE n = 0 AND carriers IS NOT NULL""")
on_cohort("stats", records.summary, f""", x AS (SELECT *, CASE WHEN len(filter) = 0 THEN '.' ELSE array_to_string(filter, ';') END AS filter_text FROM site)
  SELECT filter_text, count(*) AS n_sites, count_if({SNP}) AS n_snps, count_if({IND}) AS n_indels, count_if(len(alt) > 1) AS n_multi, count_if({SNP} AND ref || alt[1] IN ('AG', 'GA', 'CT', 'TC')) AS n_ts FROM x GROUP BY ROLLUP (filter_text)""")
on_cohort("stats_samples", records.sample_summary, """, k AS (SELECT *, a1 > 0 OR coalesce(a2, 0) > 0 AS carries FROM call WHERE a1 IS NOT NULL), n AS (SELECT site_id, count(*) AS n FROM k WHERE carries GROUP BY site_id)
  SELECT sample_id, count_if(carries) AS n_alt_sites, count_if(carries AND n = 1) AS n_private, count_if(carries AND a1 = a2) AS n_hom, count_if(a2 IS NOT NULL AND a1 <> a2) AS n_het, count_if(phased) AS n_phased FROM k LEFT JOIN n USING (site_id) GROUP BY sample_id""")
on_cohort("tstv", records.ts_tv, """, x AS (SELECT *, len(alt) > 0 AND length(ref) = 1 AND length(alt[1]) = 1 AND ref <> alt[1] AS base, ref || alt[1] IN ('AG', 'GA', 'CT', 'TC') AS ts FROM site)
  SELECT *, round(n_ts / nullif(n_tv, 0)::DOUBLE, 6) + 0.0 AS ts_tv FROM (SELECT count_if(base AND ts) AS n_ts, count_if(base AND NOT ts) AS n_tv, count(*) AS n_total, count_if(NOT coalesce(base, false)) AS n_skipped, count_if(len(alt) > 1) AS n_multi FROM x)""")
query("indel_stats", lambda s, d: records.indel_frames(mapping.cohort(s, d), mapping.intervals(s, d)), """, x AS (SELECT *, length(alt[1]) - length(ref) AS l, EXISTS (SELECT 1 FROM iv WHERE iv.chrom = site.chrom AND iv.start < pos AND iv."end" >= pos) AS exonic FROM site WHERE len(alt) > 0)
  SELECT exonic, count(*) AS n_indels, count_if(l % 3 = 0) AS n_inframe, count_if(l % 3 <> 0) AS n_frameshift FROM x WHERE l <> 0 GROUP BY exonic""")
query("fix_ploidy", lambda s, d: records.fix_ploidy(c := mapping.cohort(s, d), mapping.intervals(s, d).withColumns({"sex": F.lit("M"), "ploidy": F.lit(1)}), c.samples.selectExpr("sample_id", "CASE WHEN sample_idx % 2 = 0 THEN 'M' ELSE 'F' END AS sex")).drop("site_id").groupBy("sample_id", "ploidy").agg(F.count("*").alias("n"), F.count("a2").alias("n_second")), """, h AS (SELECT site_id FROM site WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = site.chrom AND iv.start < pos AND iv."end" >= pos)),
  x AS (SELECT c.*, h.site_id IS NOT NULL AND sample_idx % 2 = 0 AS cut FROM call c LEFT JOIN h USING (site_id)) SELECT sample_id, CASE WHEN cut THEN 1 ELSE ploidy END AS ploidy, count(*) AS n, count(CASE WHEN NOT cut THEN a2 END) AS n_second FROM x GROUP BY 1, 2""")
on_cohort("validate", lambda c: records.validate(c, {"AA"}, {"q10"}).groupBy("rule").count().withColumnRenamed("count", "n"), """, o AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY site_id) AS was FROM site),
  z AS (SELECT 'unsorted' AS rule FROM o WHERE pos < was UNION ALL SELECT 'duplicate' FROM o WHERE pos = was UNION ALL SELECT 'alt_is_ref' FROM (SELECT ref, unnest(alt) AS b FROM site) WHERE ref = b
    UNION ALL SELECT 'undeclared_info' FROM site WHERE db UNION ALL SELECT 'undeclared_filter' FROM (SELECT unnest(filter) AS f FROM site) WHERE f NOT IN ('PASS', 'q10') UNION ALL SELECT 'no_such_allele' FROM call JOIN site USING (site_id) WHERE a1 > len(alt) OR a2 > len(alt))
  SELECT rule, count(*) AS n FROM z GROUP BY rule""")


def _values(c) -> DataFrame:
    """Values for every fifth site that has an ALT."""
    rows = c.sites.filter("site_id % 5 = 0 and size(alt) > 0")
    return rows.selectExpr("chrom", "pos AS `from`", "pos AS to", "ref", "alt[0] AS alt", "concat('ann', site_id) AS id", "cast(site_id % 50 AS double) AS qual", "CASE WHEN site_id % 10 = 0 THEN '.' ELSE 'Q1' END AS filter", "concat('g', site_id % 3) AS GENE")


on_cohort("annotate_columns", lambda c: records.annotate_columns(c, _values(c)).select("chrom", "pos", "id", "qual", F.array_join("filter", ";").alias("filter"), records.info_text(F.col("info")).alias("info")), """, h AS (SELECT *, site_id % 5 = 0 AND len(alt) > 0 AS h FROM site)
  SELECT chrom, pos, CASE WHEN h THEN 'ann' || site_id ELSE id END AS id, round(CASE WHEN h THEN (site_id % 50)::DOUBLE ELSE qual END, 6) + 0.0 AS qual, CASE WHEN h AND site_id % 10 = 0 THEN '' WHEN h THEN 'Q1' ELSE array_to_string(filter, ';') END AS filter,
    coalesce(nullif(concat_ws(';', 'AA=' || aa, CASE WHEN db THEN 'DB=1' END, CASE WHEN h THEN 'GENE=g' || (site_id % 3) END), ''), '.') AS info FROM h""")
on_cohort("annotate_remove", lambda c: records.remove_columns(c.sites, ["DB"], ids=True, filters=True).select("chrom", "pos", F.coalesce("id", F.lit(".")).alias("id"), F.array_join("filter", ";").alias("filter"), records.info_text(F.col("info")).alias("info")),
  "SELECT chrom, pos, '.' AS id, '' AS filter, coalesce('AA=' || aa, '.') AS info FROM site")
on_cohort("hard_filter", lambda c: records.hard_filter(c.sites).select("chrom", "pos"), "SELECT chrom, pos FROM site WHERE len(filter) = 0 OR filter = ['PASS']")
on_cohort("shared_counts", records.shared_counts, f"""SELECT n_samples, count(*) AS n_sites, count_if({SNP}) AS n_snps, count_if(length(ref) <> 1 OR len(list_filter(alt, lambda x: length(x) <> length(ref))) > 0) AS n_indels
  FROM site JOIN (SELECT site_id, count(*) AS n_samples FROM call WHERE a1 > 0 OR coalesce(a2, 0) > 0 GROUP BY site_id) USING (site_id) GROUP BY n_samples""")
on_cohort("substitutions", records.substitutions, "SELECT ref, b AS alt, count(*) AS n FROM (SELECT ref, unnest(alt) AS b FROM site) WHERE length(ref) = 1 AND length(b) = 1 AND ref <> b GROUP BY ALL")
query("merge_equal", lambda s, d: sets.merge([mapping.first(s, d), mapping.second(s, d)], collapse="none").drop("qual", "info"), """, u AS (SELECT *, 1 AS src FROM one UNION ALL SELECT *, 2 FROM two)
  SELECT chrom, pos, ref, array_to_string(alt, ',') AS alt, array_to_string(list_sort(list_distinct(list_filter(flatten(list(filter)), lambda f: f <> 'PASS'))), ';') AS filter, string_agg(CAST(src - 1 AS VARCHAR), ',' ORDER BY src) AS sf FROM u GROUP BY chrom, pos, ref, alt""")


def _halves(s: SparkSession, d: str) -> tuple:
    """The complete phased calls of the first three and the last three fifths of all sites, by position."""
    out, last = [], mapping.cohort(s, d).sites.agg(F.max("pos")).first()[0]
    for c, part in ((mapping.first(s, d), F.col("pos") <= 0.6 * last), (mapping.second(s, d), F.col("pos") >= 0.4 * last)):
        rows = c.calls.filter("phased and a1 is not null and a2 is not null").join(c.sites.select("site_id", "chrom", "pos"), "site_id")
        out.append(rows.filter(part).select("sample_id", "chrom", "pos", "a1", "a2"))
    return tuple(out)


PHASES = """, mx AS (SELECT max(pos) AS m FROM site),
  l AS (SELECT sample_id, chrom, pos, a1, a2 FROM call1 CROSS JOIN mx WHERE phased AND a1 IS NOT NULL AND a2 IS NOT NULL AND pos <= 0.6 * m), r AS (SELECT sample_id, chrom, pos, a1, a2 FROM call2 CROSS JOIN mx WHERE phased AND a1 IS NOT NULL AND a2 IS NOT NULL AND pos >= 0.4 * m),
  b AS (SELECT l.sample_id, l.chrom, l.pos, l.a1 = r.a1 AND l.a2 = r.a2 AS same, l.a1 = r.a2 AND l.a2 = r.a1 AS crossed FROM l JOIN r ON l.sample_id = r.sample_id AND l.chrom = r.chrom AND l.pos = r.pos WHERE l.a1 <> l.a2 AND r.a1 <> r.a2),
  k AS (SELECT *, (count(*) OVER (PARTITION BY chrom, pos))::DOUBLE AS n, (sum(CASE WHEN crossed THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, pos))::DOUBLE AS c FROM b WHERE same OR crossed),
  p AS (SELECT *, CASE WHEN n = 1 THEN 0.25::DOUBLE ELSE least(greatest(c / n, 1 / n), 1 - 1 / n) END AS p FROM k), g AS (SELECT *, ln(p * p + (1 - p) * (1 - p)) AS agree, ln(2 * p * (1 - p)) AS differ FROM p),
  t AS (SELECT sample_id, chrom, count_if(same) AS n_match, count_if(crossed) AS n_swapped, sum(CASE WHEN same THEN agree ELSE differ END) AS keep, sum(CASE WHEN same THEN differ ELSE agree END) AS swapped FROM g GROUP BY ALL)
"""
query("phased_join", lambda s, d: records.phased_join(*_halves(s, d)), PHASES + """  SELECT sample_id, chrom, n_match, n_swapped, round(keep, 6) + 0.0 AS keep_likelihood, round(swapped, 6) + 0.0 AS swap_likelihood, swapped > keep AS swap, round(abs(swapped - keep) / 2.302585092994046, 6) + 0.0 AS quality FROM t""")
query("phased_join_calls", lambda s, d: records.joined_calls(*_halves(s, d)), PHASES + """,
  starts AS (SELECT *, a.p AS lp, b.p AS rp FROM (SELECT sample_id, chrom, min(pos) AS p FROM l GROUP BY ALL) a FULL JOIN (SELECT sample_id, chrom, min(pos) AS p FROM r GROUP BY ALL) b USING (sample_id, chrom)),
  every AS (SELECT *, true AS mine FROM l UNION ALL SELECT *, false FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.sample_id = r.sample_id AND l.chrom = r.chrom AND l.pos = r.pos)),
  j AS (SELECT e.*, lp, rp, t.swapped > t.keep AS swap FROM every e JOIN starts s ON e.sample_id = s.sample_id AND e.chrom = s.chrom LEFT JOIN t ON e.sample_id = t.sample_id AND e.chrom = t.chrom)
  SELECT sample_id, chrom, pos, CASE WHEN NOT mine AND coalesce(swap, false) THEN a2 ELSE a1 END AS a1, CASE WHEN NOT mine AND coalesce(swap, false) THEN a1 ELSE a2 END AS a2, CASE WHEN mine OR swap IS NOT NULL THEN lp ELSE rp END AS ps FROM j""")
on_cohort("sort", lambda c: sets.numbered(c.sites).orderBy("line").select("line", "chrom", "pos", "ref"), "SELECT row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), pos, site_id) AS line, chrom, pos, ref FROM site")

# conversions
CALLS = "string_agg({}, '{}' ORDER BY sample_idx)"
GT = "CASE WHEN ploidy = 1 THEN coalesce(CAST(a1 AS VARCHAR), '.') ELSE coalesce(CAST(a1 AS VARCHAR), '.') || CASE WHEN phased THEN '|' ELSE '/' END || coalesce(CAST(a2 AS VARCHAR), '.') END"
on_cohort("recode", lambda c: export.recode(c, ["AA"]).drop("qual"), f""", k AS (SELECT site_id, {CALLS.format(f"{GT} || ':' || coalesce(CAST(CAST(gq AS INT) AS VARCHAR), '.') || ':' || coalesce(CAST(dp AS VARCHAR), '.')", chr(9))} AS calls FROM call GROUP BY site_id)
  SELECT chrom, pos, coalesce(id, '.') AS id, ref, alt_text AS alt, CASE WHEN len(filter) = 0 THEN '.' ELSE array_to_string(filter, ';') END AS filter, coalesce('AA=' || aa, '.') AS info, 'GT:GQ:DP' AS format, calls FROM site JOIN k USING (site_id)""")
BASE = "coalesce(CASE WHEN {0} IS NOT NULL THEN coalesce(list_concat([ref], alt)[{0} + 1], '.') END, '0')"
TWO = BASE.format("a1") + " || ' ' || " + BASE.format("CASE WHEN ploidy = 1 THEN a1 ELSE a2 END")
on_cohort("plink_map", lambda c: export.plink_map(c).drop("site_id"), "SELECT substr(chrom, 4) AS chrom, coalesce(id, chrom || ':' || pos) AS id, 0 AS cm, pos FROM site WHERE len(alt) <= 1")
on_cohort("plink_tped", export.plink_tped, f""", k AS (SELECT c.site_id, {CALLS.format(TWO, " ")} AS genotypes FROM call c JOIN site USING (site_id) GROUP BY c.site_id) SELECT substr(chrom, 4) AS chrom, coalesce(id, chrom || ':' || pos) AS id, 0 AS cm, pos, genotypes FROM site JOIN k USING (site_id) WHERE len(alt) <= 1""")
on_cohort("plink_ped", export.plink_ped, f"SELECT sample_id, string_agg({TWO}, ' ' ORDER BY c.site_id) AS genotypes FROM call c JOIN site USING (site_id) WHERE len(alt) <= 1 GROUP BY sample_id")
on_cohort("matrix_012", export.matrix_012, """SELECT sample_id, string_agg(CASE WHEN a1 IS NULL AND a2 IS NULL THEN '-1' WHEN a1 = 0 AND coalesce(a2, 0) = 0 AND (ploidy = 1 OR a2 IS NOT NULL) THEN '0' WHEN a1 = 1 AND (a2 = 1 OR ploidy = 1) THEN '2' ELSE '1' END, chr(9) ORDER BY c.site_id) AS genotypes
  FROM call c JOIN site USING (site_id) WHERE len(alt) = 1 GROUP BY sample_id""")
query("impute", lambda s, d: export.impute(filters.keep_samples(c := mapping.cohort(s, d), c.samples.filter("sample_idx < 4"))), """, k AS (SELECT site_id, string_agg(a1 || ' ' || a2, ' ' ORDER BY sample_idx) AS haplotypes FROM call WHERE sample_idx < 4 GROUP BY site_id HAVING bool_and(phased AND a1 IS NOT NULL AND a2 IS NOT NULL))
  SELECT coalesce(id, chrom || ':' || pos) AS id, pos, ref AS allele0, alt[1] AS allele1, haplotypes FROM site JOIN k USING (site_id) WHERE len(alt) = 1""")
PHASED2 = "(SELECT c.site_id, sample_id, 1 AS copy, a1 AS a FROM call c UNION ALL SELECT c.site_id, sample_id, 2, a2 FROM call c)"
on_cohort("ldhat", lambda c: export.haplotype_strings(c, "chr2"), f"SELECT sample_id, copy, string_agg(coalesce(CAST(k.a AS VARCHAR), '?'), '' ORDER BY k.site_id) AS sequence FROM {PHASED2} k JOIN bi USING (site_id) WHERE chrom = 'chr2' AND all_phased GROUP BY ALL")
on_cohort("ldhelmet", lambda c: export.haplotype_strings(c, "chr2", bases=True), f"SELECT sample_id, copy, string_agg(CASE WHEN k.a IS NULL THEN 'N' ELSE coalesce(list_concat([ref], alt)[k.a + 1], '.') END, '' ORDER BY k.site_id) AS sequence FROM {PHASED2} k JOIN bi USING (site_id) WHERE chrom = 'chr2' AND all_phased GROUP BY ALL")
on_cohort("ldhat_geno", lambda c: export.genotype_strings(c, "chr3"), "SELECT sample_id, string_agg(CASE WHEN a1 IS NULL OR a2 IS NULL THEN '?' WHEN a1 <> a2 THEN '2' WHEN a1 = 0 THEN '0' ELSE '1' END, '' ORDER BY c.site_id) AS sequence FROM call c JOIN bi USING (site_id) WHERE bi.chrom = 'chr3' GROUP BY sample_id")
on_cohort("ldhat_loci", lambda c: export.loci(c, "chr2"), "SELECT pos, format('{:.4f}', pos / 1000.0::DOUBLE) AS kb FROM bi WHERE chrom = 'chr2' AND all_phased")
on_cohort("get_info", lambda c: export.get_info(c, ["AA", "DB"]), "SELECT chrom, pos, ref, array_to_string(alt, ',') AS alt, coalesce(aa, '?') AS \"AA\", CASE WHEN db THEN '1' ELSE '?' END AS \"DB\" FROM site")
on_cohort("extract_format", lambda c: export.format_field(c, F.col("dp"), SAMPLES), "SELECT chrom, pos, " + ", ".join(f"max(CASE WHEN sample_id = '{s}' THEN dp END) AS {s}" for s in SAMPLES) + " FROM call GROUP BY chrom, pos HAVING count(dp) > 0")
DECODED = "CASE WHEN {0} IS NULL THEN '.' ELSE coalesce(list_concat([ref], alt)[{0} + 1], '.') END"
DECODE = f"CASE WHEN ploidy = 1 THEN {DECODED.format('a1')} ELSE {DECODED.format('a1')} || CASE WHEN phased THEN '|' ELSE '/' END || {DECODED.format('a2')} END"
on_cohort("to_tab", export.to_tab, f"SELECT s.chrom, s.pos, s.ref, {CALLS.format(DECODE, chr(9))} AS calls FROM call c JOIN site s USING (site_id) GROUP BY s.site_id, s.chrom, s.pos, s.ref")
on_cohort("from_tab", lambda c: vcf.from_tab(export.to_tab(c), [r["sample_id"] for r in c.samples.collect()]), f""", k AS (SELECT c.site_id, s.chrom, s.pos, s.ref, sample_idx, ploidy, phased, CASE WHEN a1 IS NOT NULL THEN coalesce(list_concat([ref], alt)[a1 + 1], '.') END AS x, CASE WHEN a2 IS NOT NULL THEN coalesce(list_concat([ref], alt)[a2 + 1], '.') END AS y FROM call c JOIN site s USING (site_id)),
  l AS (SELECT site_id, flatten(list([x, y] ORDER BY sample_idx)) AS every FROM k GROUP BY site_id), m AS (SELECT l.site_id, list_filter(every, lambda v, i: v IS NOT NULL AND v <> '.' AND v <> ref AND list_position(every, v) = i) AS al FROM l JOIN site USING (site_id)),
  n AS (SELECT k.*, al, CASE WHEN x IS NULL OR x = '.' THEN '.' WHEN x = ref THEN '0' ELSE CAST(list_position(al, x) AS VARCHAR) END AS i, CASE WHEN y IS NULL OR y = '.' THEN '.' WHEN y = ref THEN '0' ELSE CAST(list_position(al, y) AS VARCHAR) END AS j FROM k JOIN m USING (site_id))
  SELECT chrom, pos, ref, CASE WHEN len(any_value(al)) = 0 THEN '.' ELSE array_to_string(any_value(al), ',') END AS alt, 'GT' AS format, string_agg(CASE WHEN ploidy = 1 THEN i ELSE i || CASE WHEN phased THEN '|' ELSE '/' END || j END, chr(9) ORDER BY sample_idx) AS calls FROM n GROUP BY site_id, chrom, pos, ref""")
on_cohort("shuffle_columns", lambda c: export.recode(records.shuffle_columns(c, SAMPLES[::-1])).select("chrom", "pos", "calls"), f"""SELECT chrom, pos, string_agg({GT} || ':' || coalesce(CAST(CAST(gq AS INT) AS VARCHAR), '.') || ':' || coalesce(CAST(dp AS VARCHAR), '.'), chr(9) ORDER BY sample_idx DESC) AS calls FROM call GROUP BY site_id, chrom, pos""")


def _likelihoods(c) -> DataFrame:
    """Phred likelihoods made from quality and depth."""
    text = F.concat_ws(",", F.coalesce("gq", F.lit(0.0)).cast("int").cast("string"), F.coalesce("dp", F.lit(0)).cast("string"), F.lit("0"))
    return export.likelihoods(c.with_(calls=c.calls.withColumn("fmt", F.create_map(F.lit("PL"), text))), "PL")


on_cohort("beagle_pl", _likelihoods, f"SELECT c.chrom, c.pos, sample_id, {R('pow(10.0::DOUBLE, CAST(coalesce(gq, 0) AS INT) / -10.0::DOUBLE)')} AS l0, {R('pow(10.0::DOUBLE, coalesce(dp, 0) / -10.0::DOUBLE)')} AS l1, 1.0::DOUBLE AS l2 FROM call c JOIN site s USING (site_id) WHERE len(alt) = 1")
on_cohort("query_template", lambda c: export.template(c, "%CHROM:%POS %REF/%ALT AA=%INFO/AA[ %SAMPLE=%GTR]"), f"SELECT s.chrom, s.pos, s.chrom || ':' || s.pos || ' ' || s.ref || '/' || alt_text || ' AA=' || coalesce(aa, '.') || string_agg(' ' || sample_id || '=' || {GT}, '' ORDER BY sample_idx) AS line FROM call c JOIN site s USING (site_id) GROUP BY s.site_id, s.chrom, s.pos, s.ref, alt_text, aa")


def _reference(s: SparkSession, d: str) -> DataFrame:
    """A made-up reference beyond the last site: every chunk of 60 bases follows from its number."""
    last = mapping.cohort(s, d).sites.agg(F.max("pos")).first()[0] or 0
    rows = s.range(0, 5 * ((last + 10) // 60 + 2)).selectExpr("concat('chr', id % 5 + 1) AS chrom", "cast(id div 5 AS int) AS k")
    return rows.selectExpr("chrom", "k * 60 + 1 AS start", "array_join(transform(sequence(1, 60), i -> substr('ACGT', cast((k * 60 + i) * 7 % 11 % 4 + 1 AS int), 1)), '') AS seq")


AT = "substr('ACGT', CAST(({}) * 7 % 11 % 4 + 1 AS INT), 1)"
query("fill_aa", lambda s, d: sequence.ancestral(mapping.cohort(s, d), _reference(s, d)), f"SELECT chrom, pos, {AT.format('pos')} AS aa FROM site")
FLANK = f"CASE WHEN i < 1 THEN 'N' ELSE {AT.format('i')} END"
query("fill_fs", lambda s, d: sequence.flanks(mapping.cohort(s, d), _reference(s, d), 10), f"""SELECT chrom, pos, array_to_string(list_transform(range(pos - 10, pos), lambda i: {FLANK}), '') || '[' || ref || '/' || array_to_string(alt, ',') || ']' || array_to_string(list_transform(range(pos + 1, pos + 11), lambda i: {FLANK}), '') AS flank FROM site""")
query("fill_ref_md5", lambda s, d: sequence.digests(_reference(s, d)), f""", n AS (SELECT ((max(pos) + 10) // 60 + 2) * 60 AS n FROM site)
  SELECT 'chr' || c AS chrom, md5(array_to_string(list_transform(range(1, n + 1), lambda i: {AT.format('i')}), '')) AS md5, CAST(n AS BIGINT) AS length FROM n CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS c)""")
query("consensus", lambda s, d: sequence.consensus(mapping.cohort(s, d), _reference(s, d), "S01"))
query("haplotypes", lambda s, d: sequence.haplotypes(mapping.cohort(s, d), _reference(s, d)))

from locusframe.plans import fielded  # noqa: E402, F401  its queries are registered too
