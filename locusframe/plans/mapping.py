"""A cohort derived from the driver's tables: parts are sites, line items are calls, suppliers modulo 20 are samples.

This is scaffolding for the registered queries and the tests; PRELUDE says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.fields import genotypes
from locusframe.schema import Cohort, Field

SAMPLES = [f"S{i:02d}" for i in range(20)]


def _sites(part: DataFrame) -> DataFrame:
    s = part.selectExpr(
        "p_partkey AS site_id", "concat('chr', p_partkey % 5 + 1) AS chrom", "cast(1 + 97 * ((p_partkey - p_partkey % 5) / 5) + p_size AS int) AS pos",
        "CASE WHEN p_partkey % 13 <> 0 THEN concat('rs', p_partkey) END AS id",
        "CASE WHEN p_size % 11 = 0 THEN substr('ACGTACGT', cast(p_partkey % 4 + 1 AS int), 3) ELSE substr('ACGT', cast(p_partkey % 4 + 1 AS int), 1) END AS ref",
        """CASE WHEN p_size % 11 = 0 THEN substr('ACGT', cast(p_partkey % 4 + 1 AS int), 1) WHEN p_size % 7 = 0 THEN concat(substr('ACGT', cast(p_partkey % 4 + 1 AS int), 1), 'TT')
           WHEN p_size % 10 = 0 THEN concat(substr('ACGT', cast((p_partkey + 1) % 4 + 1 AS int), 1), ',', substr('ACGT', cast((p_partkey + 2) % 4 + 1 AS int), 1))
           WHEN p_size = 13 THEN '.' ELSE substr('ACGT', cast((p_partkey + 1 + p_size % 3) % 4 + 1 AS int), 1) END AS alt_text""",
        "CASE WHEN p_partkey % 11 <> 0 THEN round(p_retailprice - 900.0, 2) END AS qual", "p_type AS filter_raw", "p_partkey AS line_no",
    )
    s = s.withColumn("alt", F.expr("CASE WHEN alt_text = '.' THEN cast(array() AS array<string>) ELSE split(alt_text, ',') END"))
    s = s.withColumn("filter", F.expr("CASE filter_raw WHEN 'ECONOMY' THEN array('PASS') WHEN 'LARGE' THEN cast(array() AS array<string>) WHEN 'PROMO' THEN array('PROMO', 'q10') ELSE array(filter_raw) END"))
    aa = F.expr("CASE WHEN site_id % 7 = 0 THEN NULL WHEN site_id % 5 = 0 AND size(alt) > 0 THEN alt[0] ELSE ref END")
    flag = F.when(F.col("site_id") % 4 == 0, "1")
    info = F.map_filter(F.create_map(F.lit("AA"), aa, F.lit("DB"), flag), lambda k, v: v.isNotNull())
    text = F.concat_ws(";", F.when(aa.isNotNull(), F.concat(F.lit("AA="), aa)), F.when(flag.isNotNull(), F.lit("DB")))
    return s.withColumns({"info": info, "info_raw": F.when(text == "", ".").otherwise(text), "format": F.array(F.lit("GT"), F.lit("GQ"), F.lit("DP"))}).drop("alt_text", "filter_raw")


def _calls(lineitem: DataFrame, sites: DataFrame, samples: DataFrame) -> DataFrame:
    rows = lineitem.selectExpr(
        "l_partkey AS site_id", "cast(l_suppkey % 20 AS int) AS sample_idx",
        "struct(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_discount < 0.065 THEN 0 ELSE 1 END AS a0, CASE WHEN l_tax < 0.055 THEN 0 ELSE 1 END AS b0, cast(round(l_discount * 1000) AS int) AS gq) AS x",
    )
    first = rows.groupBy("site_id", "sample_idx").agg(F.min("x").alias("x"))
    grid = sites.select("site_id", "chrom", F.size("alt").alias("n_alt")).crossJoin(F.broadcast(samples))  # at most 20 samples
    c = grid.join(first, ["site_id", "sample_idx"], "left")
    c = c.withColumn("dp", F.col("x.l_quantity").cast("int"))
    a1 = F.expr("CASE WHEN n_alt = 0 THEN x.a0 * 0 WHEN n_alt = 2 AND x.a0 = 1 AND dp % 2 = 0 THEN 2 ELSE x.a0 END")
    haploid = (F.col("chrom") == "chr5") & (F.col("sample_idx") % 2 == 1)
    a2 = F.when(~haploid, F.expr("CASE WHEN n_alt = 0 THEN x.b0 * 0 ELSE x.b0 END"))
    ft = F.expr("CASE WHEN x IS NULL THEN cast(array() AS array<string>) WHEN x.gq < 20 THEN array('q20') ELSE array('PASS') END")
    return c.select(
        "site_id", "sample_id", a1.alias("a1"), a2.alias("a2"), F.when(haploid, 1).otherwise(2).cast("tinyint").alias("ploidy"), (haploid | (F.col("site_id") % 3 != 0)).alias("phased"),
        F.col("x.gq").cast("double").alias("gq"), "dp", ft.alias("ft"), F.lit(None).cast("map<string,string>").alias("fmt"), F.lit(True).alias("included"),
    )


def cohort(spark: SparkSession, sf_dir: str) -> Cohort:
    part, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    samples = lineitem.selectExpr("cast(l_suppkey % 20 AS int) AS sample_idx").distinct().selectExpr("concat('S', lpad(sample_idx, 2, '0')) AS sample_id", "sample_idx")
    sites = _sites(part)
    return Cohort(sites, _calls(lineitem, sites, samples), samples)


def first(spark: SparkSession, sf_dir: str) -> Cohort:
    c = cohort(spark, sf_dir)
    return c.with_(sites=c.sites.filter("site_id % 7 <> 0"), calls=c.calls.filter("site_id % 7 <> 0"))


def second(spark: SparkSession, sf_dir: str) -> Cohort:
    """Other sites, some genotypes flipped, some REFs longer."""
    c = cohort(spark, sf_dir)
    sites = c.sites.filter("site_id % 6 <> 0").withColumn("ref", F.expr("CASE WHEN site_id % 23 = 0 THEN concat(ref, 'T') ELSE ref END"))
    flip = (F.col("site_id") + F.substring("sample_id", 2, 2).cast("int")) % 17 == 0
    a1 = F.when(flip & F.col("a1").isin(0, 1), 1 - F.col("a1")).otherwise(F.col("a1"))
    return c.with_(sites=sites, calls=c.calls.filter("site_id % 6 <> 0").withColumn("a1", a1))


def fielded(c: Cohort) -> Cohort:
    """With INFO AF and FORMAT PL and AD, values of the alleles' first letters and lengths (FIELDS says the same in SQL)."""
    key = lambda x: F.ascii(x) + 5 * F.length(x)
    af = F.array_join(F.transform("alt", lambda a: F.concat(F.lit("0."), (key(a) % 10).cast("string"))), ",")
    sites = c.sites.withColumns({"info": F.when(F.size("alt") > 0, F.map_concat("info", F.create_map(F.lit("AF"), af))).otherwise(F.col("info")), "format": F.array(*[F.lit(x) for x in ("GT", "PL", "AD")])})
    keys = F.transform(F.concat(F.array("ref"), F.col("alt")), key)
    calls = c.calls.join(c.sites.select("site_id", keys.alias("_k")).hint("merge"), "site_id")  # the driver broadcasts no sites
    value = lambda p: ((3 * (F.get("_k", p["i"]) + F.get("_k", p["j"])) + F.col("gq")).cast("int") % 97).cast("string")
    alone = F.transform(F.sequence(F.lit(0), F.size("_k") - 1), lambda i: F.struct(i.alias("i"), i.alias("j")))
    pl = F.array_join(F.transform(F.when(F.col("ploidy") == 1, alone).otherwise(genotypes(F.size("_k"))), value), ",")
    ad = F.array_join(F.transform("_k", lambda k: ((k + F.col("gq").cast("int")) % 31).cast("string")), ",")
    fmt = F.when(F.col("gq").isNotNull(), F.create_map(F.lit("PL"), pl, F.lit("AD"), ad))
    fields = [Field("INFO", "AF", "A", "Float"), Field("FORMAT", "PL", "G", "Integer"), Field("FORMAT", "AD", "R", "Integer")]
    return c.with_(sites=sites, calls=calls.withColumn("fmt", fmt).drop("_k"), fields=fields)


def measured(c: Cohort) -> Cohort:
    """``fielded`` with INFO of a caller (AF1, DP, DP4, PV4, MQ, VDB, HWE, G3, XY, INDEL) that follows from site_id, and FORMAT DP."""
    c = fielded(c)
    text = lambda sql: F.expr(f"cast({sql} AS string)")
    more = {
        "AF1": F.concat(F.lit("0."), F.lpad(text("site_id % 97"), 3, "0")), "DP": text("site_id % 40"), "DP4": F.concat_ws(",", *[text(f"site_id % {n}") for n in (50, 37, 11, 7)]),
        "PV4": F.when(F.col("site_id") % 3 == 0, F.concat_ws(",", *[F.concat(F.lit("0."), text(f"site_id % {n}")) for n in (9, 8, 7, 5)])), "MQ": text("site_id % 60"), "VDB": F.concat(F.lit("0."), F.lpad(text("site_id % 31"), 3, "0")),
        "HWE": F.concat(F.lit("0."), F.lpad(text("site_id % 83"), 3, "0")), "G3": F.concat(F.lit("0."), text("site_id % 5"), F.lit(",0."), text("site_id % 6"), F.lit(",0.1")), "XY": F.when(F.col("site_id") % 2 == 0, text("40 + site_id % 4")),
        "INDEL": F.when(F.exists("alt", lambda a: F.length(a) != F.length("ref")), "1"),
    }
    own = F.map_filter(F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    calls = c.calls.withColumn("fmt", F.when(F.col("fmt").isNotNull(), F.map_concat("fmt", F.create_map(F.lit("DP"), F.col("dp").cast("string")))))
    return c.with_(sites=c.sites.withColumns({"info": F.map_concat("info", own), "format": F.concat("format", F.array(F.lit("DP")))}), calls=calls)


def respelled(c: Cohort) -> Cohort:
    """Insertions and deletions with the made-up reference's next base at the end of REF and ALT; every third changed by a C."""
    base = F.expr("substr('ACGT', cast((pos + length(ref)) * 7 % 11 % 4 + 1 AS int), 1)")
    cut = (F.size("alt") == 1) & F.exists("alt", lambda a: F.length(a) != F.length("ref"))
    sites = c.sites.withColumns({"_base": base, "_cut": cut})
    alt = F.transform("alt", lambda a: F.concat(a, F.col("_base"), F.when(F.col("site_id") % 3 == 0, "C").otherwise("")))
    sites = sites.withColumns({"_alt": F.when(F.col("_cut"), alt).otherwise(F.col("alt")), "_ref": F.when(F.col("_cut"), F.concat("ref", "_base")).otherwise(F.col("ref"))})
    return c.with_(sites=sites.withColumns({"alt": F.col("_alt"), "ref": F.col("_ref")}).drop("_alt", "_ref", "_base", "_cut"))


def recut(c: Cohort) -> Cohort:
    """Every fourth site with one ALT of one base has another ALT before it, which nobody carries."""
    cut = (F.col("site_id") % 4 == 1) & (F.length("ref") == 1) & (F.size("alt") == 1) & F.forall("alt", lambda a: F.length(a) == 1)
    sites = c.sites.withColumn("_cut", cut)
    calls = c.calls.join(sites.filter("_cut").select("site_id", "_cut").hint("merge"), "site_id", "left")
    number = lambda a: F.when(F.col("_cut") & (F.col(a) == 1), 2).otherwise(F.col(a))
    sites = sites.withColumn("alt", F.when(F.col("_cut"), F.concat(F.array(F.concat("ref", F.lit("G"))), F.col("alt"))).otherwise(F.col("alt")))
    return c.with_(sites=sites.drop("_cut"), calls=calls.withColumns({"a1": number("a1"), "a2": number("a2")}).drop("_cut"))


def intervals(spark: SparkSession, sf_dir: str, every: int = 49) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(f"o_orderkey % {every} = 0")
    return orders.selectExpr("concat('chr', o_orderkey % 5 + 1) AS chrom", "cast(floor(o_orderkey * 2.5) AS int) AS start", "cast(floor(o_orderkey * 2.5) AS int) + cast(o_custkey % 200 + 1 AS int) AS end")


def populations(c: Cohort) -> DataFrame:
    return c.samples.selectExpr("sample_id", "sample_idx % 3 AS pop")


def trios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"F{k}", SAMPLES[k], SAMPLES[k + 1], SAMPLES[k + 2]) for k in range(0, 18, 3)], "family string, child string, father string, mother string")


PRELUDE = r"""WITH v_site AS (
  SELECT p_partkey AS site_id, 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS chrom, CAST(1 + 97 * ((p_partkey - p_partkey % 5) / 5) + p_size AS INT) AS pos,
    CASE WHEN p_partkey % 13 <> 0 THEN 'rs' || p_partkey END AS id,
    CASE WHEN p_size % 11 = 0 THEN substr('ACGTACGT', CAST(p_partkey % 4 + 1 AS INT), 3) ELSE substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) END AS ref,
    CASE WHEN p_size % 11 = 0 THEN substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) WHEN p_size % 7 = 0 THEN substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) || 'TT'
      WHEN p_size % 10 = 0 THEN substr('ACGT', CAST((p_partkey+1) % 4 + 1 AS INT), 1) || ',' || substr('ACGT', CAST((p_partkey+2) % 4 + 1 AS INT), 1)
      WHEN p_size = 13 THEN '.' ELSE substr('ACGT', CAST((p_partkey + 1 + p_size % 3) % 4 + 1 AS INT), 1) END AS alt_text,
    CASE WHEN p_partkey % 11 <> 0 THEN round(p_retailprice - 900.0, 2) END AS qual, p_type AS filter_raw FROM part),
site AS (
  SELECT *, CASE WHEN alt_text = '.' THEN CAST([] AS VARCHAR[]) ELSE string_split(alt_text, ',') END AS alt,
    CASE filter_raw WHEN 'ECONOMY' THEN ['PASS'] WHEN 'LARGE' THEN CAST([] AS VARCHAR[]) WHEN 'PROMO' THEN ['PROMO', 'q10'] ELSE [filter_raw] END AS filter,
    CASE WHEN site_id % 7 = 0 THEN NULL WHEN site_id % 5 = 0 AND alt_text <> '.' THEN string_split(alt_text, ',')[1] ELSE ref END AS aa, site_id % 4 = 0 AS db FROM v_site),
sample AS (SELECT DISTINCT CAST(l_suppkey % 20 AS INT) AS sample_idx, 'S' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') AS sample_id FROM lineitem),
v_call AS (SELECT * FROM (
  SELECT l_partkey AS site_id, CAST(l_suppkey % 20 AS INT) AS sample_idx, CASE WHEN l_discount < 0.065 THEN 0 ELSE 1 END AS a0, CASE WHEN l_tax < 0.055 THEN 0 ELSE 1 END AS b0,
    CAST(l_quantity AS INT) AS dp, CAST(round(l_discount * 1000) AS INT) AS gq,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey % 20 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) t WHERE rn = 1),
call AS (
  SELECT s.site_id, m.sample_id, m.sample_idx, s.chrom, s.pos,
    CASE WHEN len(s.alt) = 0 THEN c.a0 * 0 WHEN len(s.alt) = 2 AND c.a0 = 1 AND c.dp % 2 = 0 THEN 2 ELSE c.a0 END AS a1,
    CASE WHEN s.chrom = 'chr5' AND m.sample_idx % 2 = 1 THEN NULL WHEN len(s.alt) = 0 THEN c.b0 * 0 ELSE c.b0 END AS a2,
    CASE WHEN s.chrom = 'chr5' AND m.sample_idx % 2 = 1 THEN 1 ELSE 2 END AS ploidy, (s.chrom = 'chr5' AND m.sample_idx % 2 = 1) OR s.site_id % 3 <> 0 AS phased,
    CAST(c.gq AS DOUBLE) AS gq, c.dp FROM site s CROSS JOIN sample m LEFT JOIN v_call c ON c.site_id = s.site_id AND c.sample_idx = m.sample_idx),
full_call AS (SELECT * FROM call WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
copies AS (SELECT site_id, sample_id, sample_idx, a1 AS a FROM call WHERE a1 IS NOT NULL UNION ALL SELECT site_id, sample_id, sample_idx, a2 FROM call WHERE a2 IS NOT NULL),
tot AS (SELECT site_id, count(a1) + count(a2) AS n_called, CAST(sum(ploidy) AS BIGINT) AS n_chr, bool_and(ploidy = 2) AS diploid FROM call GROUP BY site_id),
allele AS (SELECT s.site_id, s.chrom, s.pos, i AS allele_idx, list_concat([ref], alt)[i + 1] AS allele, n_called, n_chr, coalesce(c.n, 0) AS count
  FROM (SELECT *, CAST(unnest(range(0, len(alt) + 1)) AS INT) AS i FROM site) s JOIN tot USING (site_id) LEFT JOIN (SELECT site_id, a, count(*) AS n FROM copies GROUP BY ALL) c ON c.site_id = s.site_id AND c.a = i),
bia AS (SELECT s.*, b.* EXCLUDE (site_id) FROM site s JOIN (
  SELECT site_id, count_if(a1 = 0) + count_if(a2 = 0) AS n_ref, count_if(a1 = 1) + count_if(a2 = 1) AS n_alt, count_if(a1 = 0 AND a2 = 0) AS r,
    count_if(a1 IS NOT NULL AND a2 IS NOT NULL AND a1 <> a2) AS h, count_if(a1 = 1 AND a2 = 1) AS a, bool_and(ploidy = 2) AS diploid, bool_and(phased) AS all_phased FROM call GROUP BY site_id) b USING (site_id) WHERE len(alt) = 1),
bi AS (SELECT * FROM bia WHERE diploid),
iv AS (SELECT 'chr' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS chrom, CAST(floor(o_orderkey * 2.5) AS INT) AS start, CAST(floor(o_orderkey * 2.5) AS INT) + CAST(o_custkey % 200 + 1 AS INT) AS "end" FROM orders WHERE o_orderkey % 49 = 0),
one AS (SELECT * FROM site WHERE site_id % 7 <> 0),
two AS (SELECT * REPLACE (CASE WHEN site_id % 23 = 0 THEN ref || 'T' ELSE ref END AS ref) FROM site WHERE site_id % 6 <> 0),
call1 AS (SELECT c.*, s.ref, s.alt_text, list_concat([s.ref], s.alt) AS al FROM call c JOIN one s USING (site_id)),
call2 AS (SELECT c.* REPLACE (CASE WHEN (c.site_id + c.sample_idx) % 17 = 0 AND a1 IN (0, 1) THEN 1 - a1 ELSE a1 END AS a1), s.ref, s.alt_text, list_concat([s.ref], s.alt) AS al FROM call c JOIN two s USING (site_id)),
shared AS (SELECT p.chrom, p.pos, p.sample_id, p.alt_text AS alts_1, q.alt_text AS alts_2, CASE WHEN p.a1 IS NOT NULL THEN coalesce(p.al[p.a1 + 1], '.') END AS x1, CASE WHEN p.a2 IS NOT NULL THEN coalesce(p.al[p.a2 + 1], '.') END AS y1, CASE WHEN q.a1 IS NOT NULL THEN coalesce(q.al[q.a1 + 1], '.') END AS x2, CASE WHEN q.a2 IS NOT NULL THEN coalesce(q.al[q.a2 + 1], '.') END AS y2,
    p.a1 AS i1, p.a2 AS j1, q.a1 AS i2, q.a2 AS j2, p.phased AS phased_1, q.phased AS phased_2,
    p.a1 IS NOT NULL AND p.a2 IS NOT NULL AND q.a1 IS NOT NULL AND q.a2 IS NOT NULL AS both_called FROM call1 p JOIN call2 q ON p.chrom = q.chrom AND p.pos = q.pos AND p.ref = q.ref AND p.sample_id = q.sample_id),
same AS (SELECT *, least(x1, y1) = least(x2, y2) AND greatest(x1, y1) = greatest(x2, y2) AS equal FROM shared),
snp AS (SELECT *, alt[1] AS b, ref || alt[1] IN ('AG', 'GA', 'CT', 'TC') AS ts FROM site WHERE len(alt) = 1 AND length(ref) = 1 AND length(alt[1]) = 1 AND ref <> alt[1])
"""
