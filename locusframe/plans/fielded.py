"""Queries over cohorts with fields listed by allele or genotype, with further INFO, and against a reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import compare, merging, records, representations, rules, sequence, sets
from locusframe.plans import mapping
from locusframe.plans.catalog import AT, _reference, query
from locusframe.schema import Cohort

#: kx: the keys of a site's own alleles; pl and ad of a call as mapping.fielded makes them, under the alleles that ``back`` (from 1) names.
KEYS = "list_transform(list_concat([ref], alt), lambda x: ascii(x) + 5 * length(x))"
PAIRS = "flatten(list_transform(range(1, len({n}) + 1), lambda i: list_transform(range(1, i + 1), lambda j: {v})))"
PL = (
    "array_to_string(CASE WHEN gq IS NULL THEN NULL WHEN ploidy = 1 THEN list_transform({b}, lambda b: coalesce(CAST((6 * kx[b] + CAST(gq AS INT)) % 97 AS VARCHAR), '.')) ELSE "
    + PAIRS.format(n="{b}", v="coalesce(CAST((3 * (kx[{b}[i]] + kx[{b}[j]]) + CAST(gq AS INT)) % 97 AS VARCHAR), '.')")
    + " END, ',')"
)
AD = "array_to_string(CASE WHEN gq IS NOT NULL THEN list_transform({b}, lambda b: coalesce(CAST((kx[b] + CAST(gq AS INT)) % 31 AS VARCHAR), '.')) END, ',')"

MERGED = f"""
, two2 AS (SELECT site_id, chrom, pos, ref, CASE WHEN cut THEN [ref || 'G', alt[1]] ELSE alt END AS alt, filter, cut
    FROM (SELECT *, coalesce(site_id % 4 = 1 AND length(ref) = 1 AND len(alt) = 1 AND length(alt[1]) = 1, false) AS cut FROM two)),
u AS (SELECT site_id, chrom, pos, ref, alt, filter, false AS cut, 1 AS src FROM one UNION ALL SELECT *, 2 FROM two2),
lr AS (SELECT chrom, pos, arg_max(ref, length(ref) * 10 - src) AS mr FROM u GROUP BY ALL),
e AS (SELECT u.*, mr, list_transform(alt, lambda a: a || substr(mr, length(ref) + 1)) AS ext, {KEYS} AS kx FROM u JOIN lr ON u.chrom = lr.chrom AND u.pos = lr.pos),
f AS (SELECT chrom, pos, flatten(list(ext ORDER BY src)) AS al0, string_agg((src - 1) || CASE WHEN len(filter) = 0 OR filter = ['PASS'] THEN '' ELSE 'f' END, ',' ORDER BY src) AS sf FROM e GROUP BY ALL),
g AS (SELECT chrom, pos, sf, list_filter(al0, lambda v, i: list_position(al0, v) = i) AS al FROM f),
m AS (SELECT e.*, al, sf, list_concat([1], list_transform(al, lambda a: CASE WHEN list_contains(ext, a) THEN list_position(ext, a) + 1 END)) AS back FROM e JOIN g ON e.chrom = g.chrom AND e.pos = g.pos),
c0 AS (SELECT site_id, sample_id, a1, a2, ploidy, gq, 1 AS src FROM call1 UNION ALL SELECT site_id, sample_id, a1, a2, ploidy, gq, 2 FROM call2),
c1 AS (SELECT m.*, c0.sample_id, ploidy, gq, CASE WHEN cut AND a1 = 1 THEN 2 ELSE a1 END AS o1, CASE WHEN cut AND a2 = 1 THEN 2 ELSE a2 END AS o2 FROM c0 JOIN m USING (site_id, src)),
c2 AS (SELECT *, CASE WHEN o1 = 0 THEN 0 WHEN ext[o1] IS NOT NULL THEN list_position(al, ext[o1]) END AS a1, CASE WHEN o2 = 0 THEN 0 WHEN ext[o2] IS NOT NULL THEN list_position(al, ext[o2]) END AS a2 FROM c1)
"""


def _inputs(spark, sf_dir) -> list[Cohort]:
    return [mapping.fielded(mapping.first(spark, sf_dir)), mapping.fielded(mapping.recut(mapping.second(spark, sf_dir)))]


def _info(df, *keys):
    return df.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), *[F.element_at("info", k).alias(k.lower()) for k in keys])


query("merge_info", lambda s, d: _info(merging.merged_cohort(_inputs(s, d)).sites, "AN", "AC", "AF", "SF"), MERGED + """,
n AS (SELECT chrom, pos, a, count(*) AS n FROM (SELECT chrom, pos, a1 AS a FROM c2 UNION ALL SELECT chrom, pos, a2 FROM c2) WHERE a IS NOT NULL GROUP BY ALL),
na AS (SELECT chrom, pos, map_from_entries(list((a, n))) AS by_allele, sum(n)::BIGINT AS an FROM n GROUP BY ALL),
af AS (SELECT chrom, pos, list(list_transform(back[2:], lambda b: '0.' || (kx[b] % 10)) ORDER BY src) FILTER (len(alt) > 0) AS x FROM m GROUP BY ALL)
SELECT g.chrom, g.pos, mr AS ref, array_to_string(al, ',') AS alt, CAST(coalesce(an, 0) AS VARCHAR) AS an,
  CASE WHEN len(al) > 0 THEN array_to_string(list_transform(range(1, len(al) + 1), lambda i: CAST(coalesce(by_allele[CAST(i AS INT)], 0) AS VARCHAR)), ',') END AS ac,
  CASE WHEN len(al) > 0 THEN array_to_string(list_transform(range(1, len(al) + 1), lambda i: coalesce(x[1][i], x[2][i], '.')), ',') END AS af, sf
FROM g JOIN lr ON g.chrom = lr.chrom AND g.pos = lr.pos LEFT JOIN na ON g.chrom = na.chrom AND g.pos = na.pos LEFT JOIN af ON g.chrom = af.chrom AND g.pos = af.pos""")  # fmt: skip


def _call_rows(c: Cohort):
    rows = c.calls.join(c.sites.select("site_id", "chrom", "pos"), "site_id")
    return rows.select("chrom", "pos", "sample_id", "a1", "a2", F.col("ploidy").cast("int").alias("ploidy"), F.element_at("fmt", "PL").alias("pl"), F.element_at("fmt", "AD").alias("ad"))


query("merge_fields", lambda s, d: _call_rows(merging.merged_cohort(_inputs(s, d))), MERGED + f""",
every AS (SELECT chrom, pos, k AS src, sample_id FROM g, (SELECT unnest([1, 2]) AS k), sample)
SELECT every.chrom, every.pos, every.src || '_' || every.sample_id AS sample_id, CAST(a1 AS INT) AS a1, CAST(a2 AS INT) AS a2, CAST(coalesce(ploidy, 2) AS INT) AS ploidy, {PL.format(b='back')} AS pl, {AD.format(b='back')} AS ad
FROM every LEFT JOIN c2 ON every.chrom = c2.chrom AND every.pos = c2.pos AND every.src = c2.src AND every.sample_id = c2.sample_id""")  # fmt: skip

CARRIED = f"""
, mine AS (SELECT site_id, list_sort(list(DISTINCT a)) AS k FROM copies WHERE sample_idx < 4 AND a > 0 GROUP BY site_id),
t AS (SELECT s.*, list_concat([1], list_transform(coalesce(k, []), lambda a: a + 1)) AS back, {KEYS} AS kx FROM site s LEFT JOIN mine USING (site_id))
"""


def _four(spark, sf_dir) -> Cohort:
    c = mapping.fielded(mapping.cohort(spark, sf_dir))
    return merging.subset_cohort(c, c.samples.filter("sample_idx < 4"))


query("subset_trimmed", lambda s, d: _info(_four(s, d).sites, "AN", "AC", "AF"), CARRIED + """,
n AS (SELECT site_id, a, count(*) AS n FROM copies WHERE sample_idx < 4 GROUP BY ALL), na AS (SELECT site_id, map_from_entries(list((a, n))) AS by_allele, sum(n)::BIGINT AS an FROM n GROUP BY ALL)
SELECT chrom, pos, ref, array_to_string(list_transform(back[2:], lambda b: alt[b - 1]), ',') AS alt, CAST(coalesce(an, 0) AS VARCHAR) AS an,
  CASE WHEN len(back) > 1 THEN array_to_string(list_transform(back[2:], lambda b: CAST(coalesce(by_allele[CAST(b - 1 AS INT)], 0) AS VARCHAR)), ',') END AS ac,
  CASE WHEN len(alt) > 0 THEN CASE WHEN len(back) > 1 THEN array_to_string(list_transform(back[2:], lambda b: '0.' || (kx[b] % 10)), ',') ELSE '.' END END AS af FROM t LEFT JOIN na USING (site_id)""")  # fmt: skip
query("subset_trimmed_calls", lambda s, d: _call_rows(_four(s, d)), CARRIED + f"""
SELECT t.chrom, t.pos, sample_id, CAST(CASE WHEN a1 = 0 THEN 0 ELSE list_position(back, a1 + 1) - 1 END AS INT) AS a1, CAST(CASE WHEN a2 = 0 THEN 0 ELSE list_position(back, a2 + 1) - 1 END AS INT) AS a2, CAST(ploidy AS INT) AS ploidy,
  {PL.format(b='back')} AS pl, {AD.format(b='back')} AS ad FROM call JOIN t USING (site_id) WHERE sample_idx < 4""")  # fmt: skip

query("contrast_likelihood", lambda s, d: records.novelty(mapping.fielded(mapping.cohort(s, d)), ["S00", "S01"], ["S02", "S03", "S04"]).drop("site_id"), f"""
, k AS (SELECT c.site_id, sample_id, sample_idx, gq, ploidy, {KEYS} AS kx, range(1, len(alt) + 2) AS b FROM call c JOIN site USING (site_id) WHERE len(alt) > 0 AND gq IS NOT NULL AND sample_idx < 5),
p AS (SELECT *, {PAIRS.format(n='b', v='CASE WHEN ploidy = 2 THEN (3 * (kx[i] + kx[j]) + CAST(gq AS INT)) % 97 WHEN i = j THEN (6 * kx[i] + CAST(gq AS INT)) % 97 ELSE 255 END')} AS pl, {PAIRS.format(n='b', v='[j, i]')} AS gts FROM k),
q AS (SELECT site_id, sample_id, sample_idx, pl, gts[list_position(pl, list_min(pl))] AS gt FROM p),
d AS (SELECT a.site_id, a.sample_id, min(list_min(list_transform(range(1, len(a.pl) + 1), lambda i: a.pl[i] + b.pl[i]))) AS score, bool_or(a.gt <> b.gt) AS genotype,
    len(list_filter(any_value(a.gt), lambda x: NOT list_contains(flatten(list(b.gt)), x))) > 0 AS allele FROM q a JOIN q b ON a.site_id = b.site_id AND a.sample_idx < 2 AND b.sample_idx > 1 GROUP BY ALL),
r AS (SELECT site_id, min(score) FILTER (score > 0) AS novelty, coalesce(string_agg(sample_id, ',' ORDER BY sample_id) FILTER (allele AND score > 0), '') AS al, coalesce(string_agg(sample_id, ',' ORDER BY sample_id) FILTER (genotype), '') AS gt FROM d GROUP BY site_id)
SELECT chrom, pos, CAST(novelty AS INT) AS novelty, al AS novel_alleles, CASE WHEN al = '' THEN gt ELSE '' END AS novel_genotypes FROM r JOIN site USING (site_id) WHERE novelty IS NOT NULL AND (al <> '' OR gt <> '')""")  # fmt: skip


def _ploidies(spark, sf_dir):
    c = mapping.fielded(mapping.cohort(spark, sf_dir))
    regions = mapping.intervals(spark, sf_dir).withColumn("_p", F.explode(F.array(*[F.struct(F.lit(x).alias("sex"), F.lit(n).alias("ploidy")) for x, n in (("M", 1), ("F", 2), ("U", 0))]))).select("chrom", "start", "end", "_p.*")
    sexes = c.samples.selectExpr("sample_id", "element_at(array('M', 'F', 'U'), sample_idx % 3 + 1) AS sex")
    rows = records.fix_ploidy(c, regions, sexes, likelihoods=True).join(c.sites.select("site_id", "chrom", "pos"), "site_id")
    return rows.select("chrom", "pos", "sample_id", "a1", "a2", "ploidy", F.element_at("fmt", "PL").alias("pl"))


query("fix_ploidy_likelihoods", _ploidies, f"""
, h AS (SELECT site_id FROM site WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = site.chrom AND iv.start < pos AND iv."end" >= pos)),
x AS (SELECT c.*, {KEYS} AS kx, range(1, len(alt) + 2) AS b, CASE WHEN h.site_id IS NOT NULL THEN CASE sample_idx % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END END AS wanted FROM call c JOIN site s USING (site_id) LEFT JOIN h USING (site_id)),
y AS (SELECT *, wanted = 0 AND (a1 IS NOT NULL OR a2 IS NOT NULL) AS removed, coalesce(wanted > 0 AND wanted <> ploidy, false) AS changed, list_transform(b, lambda i: (6 * kx[i] + CAST(gq AS INT)) % 97) AS hom, {PL.format(b='b')} AS pl0 FROM x),
z AS (SELECT *, coalesce(removed, false) AS gone, CASE WHEN gq IS NULL THEN a1 ELSE list_position(hom, list_min(hom)) - 1 END AS best FROM y)
SELECT chrom, pos, sample_id, CAST(CASE WHEN gone THEN NULL WHEN changed THEN best ELSE a1 END AS INT) AS a1, CAST(CASE WHEN gone THEN NULL WHEN changed THEN CASE WHEN wanted = 2 THEN best END WHEN wanted = 1 THEN NULL ELSE a2 END AS INT) AS a2,
  CAST(CASE WHEN gone THEN 1 WHEN changed THEN wanted ELSE ploidy END AS INT) AS ploidy,
  CASE WHEN gq IS NULL THEN NULL WHEN (gone AND ploidy = 2) OR (changed AND wanted = 1) THEN array_to_string(list_transform(hom, lambda v: CAST(v AS VARCHAR)), ',')
    WHEN changed THEN array_to_string({PAIRS.format(n='b', v="CASE WHEN i = j THEN CAST(hom[i] AS VARCHAR) ELSE '.' END")}, ',') ELSE pl0 END AS pl FROM z""")  # fmt: skip


INFO_SQL = """, q AS (SELECT *, CAST('0.' || lpad(CAST(site_id % 97 AS VARCHAR), 3, '0') AS DOUBLE) AS af1, site_id % 40 AS dp, site_id % 60 AS mq, CAST('0.' || lpad(CAST(site_id % 31 AS VARCHAR), 3, '0') AS DOUBLE) AS vdb,
  CAST('0.' || lpad(CAST(site_id % 83 AS VARCHAR), 3, '0') AS DOUBLE) AS hwe, (site_id % 5) / 10.0::DOUBLE AS rr, (site_id % 6) / 10.0::DOUBLE AS ra, len(list_filter(alt, lambda a: length(a) <> length(ref))) > 0 AS indel,
  len(list_filter(alt, lambda a: length(a) = length(ref) AND a <> ref)) > 0 AS has_snp,
  len(list_filter(alt, lambda a: length(a) <> length(ref) AND (a[:least(length(a), length(ref))] = ref[:least(length(a), length(ref))] OR right(a, least(length(a), length(ref))) = right(ref, least(length(a), length(ref)))))) > 0 AS has_indel FROM site)"""
FILTERED = "coalesce(nullif(array_to_string(list_sort(list_distinct(list_concat(list_filter(filter, lambda f: {kept}), list_filter([{new}], lambda f: f IS NOT NULL)))), ';'), ''), 'PASS')"

query("local_filters", lambda s, d: records.named_filters((c := mapping.measured(mapping.cohort(s, d))).sites, records.local_rules(MinDP=5, MaxDP=35, MinMQ=10, MinAB=2, Qual=50, VDB=0.005, HWE_G3=0.04, RefN=1, StrandBias=0.2, BaseQualBias=0.2, MapQualBias=0.2, EndDistBias=0.2)).select("chrom", "pos", F.array_join("filter", ";").alias("filter")),
  INFO_SQL + f"""SELECT chrom, pos, {FILTERED.format(kept="f <> 'PASS'", new="CASE WHEN dp < 5 THEN 'MinDP' END, CASE WHEN dp > 35 THEN 'MaxDP' END, CASE WHEN mq < 10 THEN 'MinMQ' END, CASE WHEN site_id % 11 + site_id % 7 < 2 THEN 'MinAB' END, CASE WHEN qual < 50 THEN 'Qual' END, CASE WHEN vdb < 0.005 THEN 'VDB' END, CASE WHEN hwe < 0.04 AND rr + ra / 2 > 0 AND rr + ra / 2 < 1 AND ra > 2 * (rr + ra / 2) * (1 - (rr + ra / 2)) THEN 'HWE_G3' END, " + ", ".join(f"CASE WHEN site_id % 3 = 0 AND (site_id % {n}) / 10.0 < 0.2 THEN '{k}' END" for n, k in ((9, "StrandBias"), (8, "BaseQualBias"), (7, "MapQualBias"), (5, "EndDistBias"))))} AS filter FROM q""")
query("user_rules", lambda s, d: (c := rules.apply_rules(mapping.measured(mapping.cohort(s, d)), rules.EXAMPLES)).sites.select("chrom", "pos", F.array_join("filter", ";").alias("filter"), *[F.element_at("info", k).alias(k.lower()) for k in ("PV0", "PV3", "SINGLETON")]),
  INFO_SQL + f""", h AS (SELECT c.site_id, count(CASE WHEN a1 > 0 OR a2 > 0 THEN 1 END) AS carriers, coalesce(bool_or(ploidy = 2 AND len(alt) = 1 AND (3 * (x + y) + CAST(gq AS INT)) % 97 < (6 * x + CAST(gq AS INT)) % 97 AND (3 * (x + y) + CAST(gq AS INT)) % 97 < (6 * y + CAST(gq AS INT)) % 97), false)
      OR coalesce(bool_or(ploidy = 1 AND len(alt) = 2 AND (6 * y + CAST(gq AS INT)) % 97 < (6 * x + CAST(gq AS INT)) % 97 AND (6 * y + CAST(gq AS INT)) % 97 < (6 * z + CAST(gq AS INT)) % 97), false)
      OR coalesce(bool_or(ploidy = 2 AND len(alt) = 2 AND (3 * (x + y) + CAST(gq AS INT)) % 97 < (6 * x + CAST(gq AS INT)) % 97 AND (3 * (x + y) + CAST(gq AS INT)) % 97 < (6 * y + CAST(gq AS INT)) % 97), false) AS hets
    FROM call c JOIN (SELECT site_id, alt, ascii(ref) + 5 * length(ref) AS x, ascii(alt[1]) + 5 * length(alt[1]) AS y, ascii(alt[2]) + 5 * length(alt[2]) AS z FROM site) s USING (site_id) GROUP BY ALL)
  SELECT chrom, pos, {FILTERED.format(kept="f NOT IN ('PASS')", new="CASE WHEN af1 < 0.01 THEN 'MinAF' END, CASE WHEN indel AND has_indel THEN 'Indel' END, CASE WHEN has_snp AND 0.1 * (site_id % 50 + site_id % 37) <= site_id % 11 + site_id % 7 THEN 'FewAlts' END, CASE WHEN has_snp AND hets THEN 'NoHets' END, CASE WHEN NOT (site_id % 2 = 0 AND site_id % 4 = 2) THEN 'XY' END")} AS filter,
    CASE WHEN site_id % 3 = 0 THEN '0.' || (site_id % 9) END AS pv0, CASE WHEN site_id % 3 = 0 THEN '0.' || (site_id % 5) END AS pv3, CASE WHEN carriers = 1 THEN '1' END AS singleton FROM q JOIN h USING (site_id)""")  # fmt: skip

TEXT = f"array_to_string(list_transform(range({{a}}, {{b}} + 1), lambda p: {AT.format('p')}), '')"
query("compare_sequences", lambda s, d: representations.compare_sequences([mapping.first(s, d), mapping.respelled(mapping.second(s, d))], _reference(s, d), 60), f"""
, b AS (SELECT *, len(alt) = 1 AND length(alt[1]) <> length(ref) AS cut, {AT.format('pos + length(ref)')} AS nb FROM two),
b2 AS (SELECT chrom, pos, CASE WHEN cut THEN ref || nb ELSE ref END AS ref, CASE WHEN cut THEN [alt[1] || nb || CASE WHEN site_id % 3 = 0 THEN 'C' ELSE '' END] ELSE alt END AS alt FROM b),
u AS (SELECT 0 AS src, chrom, pos, ref, alt FROM one UNION ALL SELECT 1, * FROM b2),
l AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 60 THEN 0 ELSE 1 END AS new FROM u),
k AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM l),
w AS (SELECT chrom, c, min(pos)::INT AS first, max(pos)::INT AS last FROM k GROUP BY ALL),
e AS (SELECT src, k.chrom, k.c, first, last, length(a) <> length(ref) AS complex, {TEXT.format(a='greatest(1, first - 20)', b='pos - 1')} || a || {TEXT.format(a='pos + length(ref)', b='last + 20')} AS seq
    FROM (SELECT *, unnest(alt) AS a FROM k) k JOIN w ON k.chrom = w.chrom AND k.c = w.c),
t AS (SELECT chrom, c FROM e GROUP BY ALL HAVING bool_or(complex AND src = 0) AND bool_or(complex AND src = 1))
SELECT chrom, first, last, '0,1' AS files, EXISTS (SELECT 1 FROM e x JOIN e y ON x.seq = y.seq AND x.src = 0 AND y.src = 1 WHERE x.chrom = w.chrom AND x.c = w.c AND y.chrom = w.chrom AND y.c = w.c) AS match FROM w JOIN t USING (chrom, c)""")  # fmt: skip


def _shifted(c: Cohort) -> Cohort:
    """Records with a REF of three bases start a base later."""
    return c.with_(sites=c.sites.withColumn("pos", F.col("pos") + F.when(F.length("ref") == 3, 1).otherwise(0)))


query("diff_site_overlap", lambda s, d: compare.overlapping_sites(mapping.first(s, d), _shifted(mapping.second(s, d))), """
, a AS (SELECT chrom, pos, ref, array_to_string(alt, ',') AS alt FROM one), b AS (SELECT chrom, pos + CASE WHEN length(ref) = 3 THEN 1 ELSE 0 END AS pos, ref, array_to_string(alt, ',') AS alt FROM two)
SELECT coalesce(a.chrom, b.chrom) AS chrom, a.pos AS pos_1, b.pos AS pos_2, CASE WHEN b.pos IS NULL THEN '1' WHEN a.pos IS NULL THEN '2' WHEN a.pos = b.pos AND a.ref = b.ref THEN 'B' ELSE 'O' END AS files, a.ref AS ref_1, b.ref AS ref_2, a.alt AS alt_1, b.alt AS alt_2
FROM a FULL JOIN b ON a.chrom = b.chrom AND a.pos < b.pos + length(b.ref) AND b.pos < a.pos + length(a.ref)""")  # fmt: skip


def _features(spark, sf_dir):
    return mapping.intervals(spark, sf_dir).select("chrom", (F.col("start") + 1).alias("start"), F.col("end"))


query("lift_features", lambda s, d: sequence.lifted(mapping.cohort(s, d), _features(s, d).withColumn("name", F.concat_ws(":", "chrom", "start", "end"))).groupBy("sample_id", "copy", "name", "start", "end").agg(F.count("*").alias("n")), """
, f AS (SELECT DISTINCT chrom, start + 1 AS s, "end" AS e, count(*) OVER (PARTITION BY chrom, start, "end") AS n FROM iv),
c AS (SELECT site_id, sample_id, 1 AS copy, a1 AS a FROM call WHERE phased UNION ALL SELECT site_id, sample_id, 2, coalesce(a2, CASE WHEN ploidy = 1 THEN a1 END) FROM call WHERE phased),
v AS (SELECT sample_id, copy, chrom, pos, length(alt[a]) AS new, length(ref) AS old FROM c JOIN site USING (site_id) WHERE a > 0 AND length(alt[a]) <> length(ref)),
m AS (SELECT *, unnest([{'k': 's', 'x': s}, {'k': 'e', 'x': e}]) AS q FROM f, sample, (SELECT unnest([1, 2]) AS copy)),
p AS (SELECT m.chrom, m.s, m.e, m.n, m.sample_id, m.copy, m.q.k AS k, m.q.x AS x, sum(CASE WHEN v.pos + old <= m.q.x THEN new - old ELSE 0 END) AS shift, max(CASE WHEN v.pos + new <= m.q.x AND m.q.x < v.pos + old THEN v.pos + new END) AS hole
    FROM m LEFT JOIN v ON v.sample_id = m.sample_id AND v.copy = m.copy AND v.chrom = m.chrom AND v.pos <= m.q.x GROUP BY ALL),
r AS (SELECT chrom, s, e, n, sample_id, copy, max(CASE WHEN k = 's' THEN coalesce(shift, 0) + coalesce(hole, x) END) AS start, max(CASE WHEN k = 'e' THEN coalesce(shift, 0) + coalesce(hole - 1, x) END) AS "end", max(CASE WHEN k = 's' THEN hole END) AS hs, max(CASE WHEN k = 'e' THEN hole END) AS he FROM p GROUP BY ALL)
SELECT sample_id, copy, chrom || ':' || s || ':' || e AS name, start::BIGINT AS start, "end"::BIGINT AS "end", n FROM r WHERE coalesce(hs <> he, true)""")  # fmt: skip


def _old_form(c: Cohort):
    """Single ALTs of another length as I with bases or D with a number."""
    old = F.when(F.length("ref") == 3, F.array(F.lit("D2"))).when((F.size("alt") == 1) & (F.length(F.get("alt", F.lit(0))) == 3), F.array(F.lit("ITT")))
    rows = c.sites.withColumns({"_alt": F.coalesce(old, "alt"), "_ref": F.substr("ref", F.lit(1), F.lit(1))})
    return rows.withColumns({"alt": F.col("_alt"), "ref": F.col("_ref")}).drop("_alt", "_ref")


def _form(df):
    return df.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"))


query("convert_anchored", lambda s, d: _form(representations.to_anchored(_old_form(mapping.cohort(s, d)), _reference(s, d))), f"""
, x AS (SELECT *, length(ref) = 3 AS lost, length(ref) < 3 AND len(alt) = 1 AND length(alt[1]) = 3 AS won, {AT.format('pos')} = ref[1] AS fits FROM site)
SELECT chrom, pos, CASE WHEN lost AND fits THEN ref[1] || {AT.format('pos + 1')} || {AT.format('pos + 2')} ELSE ref[1] END AS ref,
  CASE WHEN lost AND fits THEN ref[1] WHEN lost THEN 'D2' WHEN won AND fits THEN ref[1] || 'TT' WHEN won THEN 'ITT' ELSE array_to_string(alt, ',') END AS alt FROM x""")  # fmt: skip
query("convert_marked", lambda s, d: _form(representations.to_marked(mapping.cohort(s, d).sites)), """
SELECT chrom, pos, CASE WHEN length(ref) = 3 THEN ref[1] ELSE ref END AS ref, CASE WHEN length(ref) = 3 THEN 'D2' WHEN len(alt) = 1 AND length(alt[1]) = 3 THEN 'ITT' ELSE array_to_string(alt, ',') END AS alt FROM site""")  # fmt: skip
query("isec_combinations", lambda s, d: (i := [mapping.first(s, d), mapping.second(s, d)])[0].sites.select(F.lit(1).alias("src"), "site_id", "chrom", "pos").unionByName(i[1].sites.select(F.lit(2).alias("src"), "site_id", "chrom", "pos")).join(sets.combinations(i), ["src", "site_id"]).select("files", "src", "chrom", "pos"), """
SELECT CASE WHEN a.pos IS NULL THEN '1' WHEN b.pos IS NULL THEN '0' ELSE '0_1' END AS files, CASE WHEN a.pos IS NULL THEN 2 ELSE 1 END AS src, coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos
FROM one a FULL JOIN two b ON a.chrom = b.chrom AND a.pos = b.pos""")  # fmt: skip
