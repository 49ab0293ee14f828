"""Hand-computed cases on small variant files."""

import pytest

from locusframe.operators import compare, export, filters, individual, ld, records, sequence, site, windows
from locusframe.operators.filters import Filters
from locusframe.sources import side, vcf

HEAD = [
    "##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total, depth">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="db">', '##FILTER=<ID=q10,Description="low">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\tD",
]
ROWS = [
    "1\t10\trs1\ta\tg\t50\tPASS\tDP=9;DB\tGT:GQ:DP\t0/0:99:9\t0/1:120:8\t1/1:10:2\t./.:.:.",
    "1\t15\t.\tC\tT,G\t.\tq10;a1\tDP=3\tGT:DP\t0|1:5\t1|2:5\t2|2:5\t0|0:5",
    "1\t20\t.\tG\t.\t10\t.\t.\tGT\t0/0\t0/0\t0/0\t0/0",
    "1\t31\t.\tAT\tA\t30\tPASS\tDB\tGT\t0/1\t0/.\t0/0\t1/1",
    "X\t40\t.\tT\tC\t30\tPASS\t.\tGT\t0\t1\t.\t0/1",
]


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("vcf") / "a.vcf"
    f.write_text("\n".join(HEAD + ROWS) + "\n")
    return vcf.read(spark, f"file://{f}")


def test_reader(cohort):
    s = {r.pos: r for r in cohort.sites.collect()}
    assert [f.id for f in cohort.fields] == ["DP", "DB", "q10"]
    assert s[10].ref == "A" and s[10].alt == ["G"] and s[10].info == {"DP": "9", "DB": "1"}
    assert s[15].filter == ["a1", "q10"] and s[15].qual is None and s[15].id is None
    assert s[20].alt == [] and s[20].filter == [] and s[20].info == {}
    c = {(r.site_id, r.sample_id): r for r in cohort.calls.collect()}
    assert c[s[10].site_id, "B"].gq == 99.0 and c[s[10].site_id, "D"].a1 is None and c[s[10].site_id, "D"].ploidy == 2
    assert c[s[40].site_id, "C"].ploidy == 1 and c[s[40].site_id, "C"].phased and c[s[40].site_id, "C"].a1 is None
    assert c[s[31].site_id, "B"].a1 == 0 and c[s[31].site_id, "B"].a2 is None


def test_frequencies_count_alleles_one_by_one(cohort):
    f = {(r.pos, r.allele): r for r in site.frequencies(cohort).collect()}
    assert (f[10, "G"]["count"], f[10, "G"].n_called, f[10, "G"].n_chr) == (3, 6, 8)
    assert (f[31, "A"]["count"], f[31, "A"].n_called) == (3, 7)
    assert (f[40, "C"]["count"], f[40, "C"].n_chr) == (2, 5)


def test_masked_calls_stay_in_the_chromosome_count(cohort):
    masked = filters.apply(cohort, Filters(min_dp=5))
    f = {(r.pos, r.allele): r for r in site.frequencies(masked).collect()}
    assert (f[10, "G"]["count"], f[10, "G"].n_called, f[10, "G"].n_chr) == (1, 4, 8)
    m = {r.pos: r for r in site.missing(masked).collect()}
    assert m[10].n_filtered == 4


def test_haploid_calls_take_a_site_out_of_diploid_statistics(cohort):
    assert {r.pos for r in site.hardy(cohort).collect()} == {10, 31}
    assert 40 not in {r.pos for r in site.pi(cohort).collect()}


@pytest.mark.parametrize("counts, p", [((10, 0, 0), 1.0), ((5, 0, 5), 252 / 184756), ((57, 14, 50), 0.0)])
def test_exact_test(spark, counts, p):
    from pyspark.sql import functions as F

    from locusframe.functions.alleles import hwe_exact

    r = spark.createDataFrame([counts], "r long, h long, a long").select(hwe_exact(F.col("r"), F.col("h"), F.col("a")).alias("x")).first().x
    assert r.p_hwe == pytest.approx(p, abs=2e-5) and 0 <= r.p_lo <= 1 and 0 <= r.p_hi <= 1


def test_thinning_is_greedy(spark, cohort):
    rows = [(i, "1", p, i) for i, p in enumerate([10, 15, 20, 31, 40])]
    sites = spark.createDataFrame(rows, "site_id long, chrom string, pos int, line_no long")
    assert sorted(r.pos for r in filters.thin(sites, 10).collect()) == [10, 20, 31]


def test_intervals_are_open_at_the_start(spark, cohort):
    bed = spark.createDataFrame([("1", 10, 15), ("1", 31, 31)], "chrom string, start int, end int")
    kept = {r.pos for r in filters.apply(cohort, Filters(bed=bed)).sites.collect()}
    rest = {r.pos for r in filters.apply(cohort, Filters(exclude_bed=bed)).sites.collect()}
    assert kept == {15} and kept | rest == {10, 15, 20, 31, 40}


def test_windows_hold_their_edges(spark):
    from pyspark.sql import functions as F

    from locusframe.operators.counts import in_windows

    got = spark.createDataFrame([(1,), (10,), (11,)], "pos int").select("pos", in_windows(F.col("pos"), 10, 5).alias("k")).collect()
    assert sorted((r.pos, r.k) for r in got) == [(1, 0), (10, 0), (10, 1), (11, 1), (11, 2)]


def test_site_filters(cohort):
    pos = lambda **k: sorted(r.pos for r in filters.apply(cohort, Filters(**k)).sites.collect())
    assert pos(indels=True) == [31] and pos(min_alleles=3) == [15]
    assert pos(remove_filtered_all=True) == [10, 20, 31, 40] and pos(keep_filtered=("q10",)) == [15]
    assert pos(min_q=30) == [10, 31, 40] and pos(keep_info=("DB",)) == [10, 31]
    assert pos(chrom=("1",), from_bp=15, to_bp=20) == [15, 20]
    assert pos(phased=True) == [15]
    assert pos(max_missing=1.0) == [15, 20]


def test_comparison_of_a_cohort_with_itself(cohort):
    assert {r.files for r in compare.sites(cohort, cohort).collect()} == {"B"}
    assert all(r.n_discord == 0 for r in compare.discordance_by_sample(cohort, cohort).collect())


def test_r2_is_symmetric_and_bounded(cohort):
    rows = ld.genotype_r2(cohort, 100).collect()
    assert rows and all(r.r2 is None or 0 <= r.r2 <= 1 for r in rows)


def test_chi_square_tail(spark):
    from pyspark.sql import functions as F

    from locusframe.operators.ld import chisq_tail

    rows = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (9.487729, 4), (11.0705, 5), (30.0, 1)], "x double, d int").select(chisq_tail(F.col("x"), F.col("d")).alias("p")).collect()
    assert [r.p for r in rows[:4]] == pytest.approx([0.05] * 4, abs=1e-6) and rows[4].p == pytest.approx(4.32e-8, rel=1e-2)


def test_round_trip(spark, cohort, tmp_path):
    vcf.write(cohort, f"file://{tmp_path}/out")
    again = vcf.read(spark, f"file://{tmp_path}/out/*")
    key = lambda c: sorted((r.chrom, r.pos, r.ref, tuple(r.alt), tuple(r.filter), tuple(sorted(r.info.items()))) for r in c.sites.collect())
    assert key(cohort) == key(again)
    gts = lambda c: sorted((r.chrom, r.pos, r.calls) for r in export.recode(c).collect())
    assert gts(cohort) == gts(again)


def test_template(cohort):
    line = export.template(cohort, "%CHROM:%POS[ %SAMPLE=%GT]").filter("pos = 15").first().line
    assert line == "1:15 A=C|T B=T|G C=G|G D=C|C"


def test_event_types(spark):
    from pyspark.sql import functions as F

    from locusframe.functions.alleles import event_type, normalize_alleles

    cases = {("A", "C"): "s", ("AC", "GT"): "s", ("A", "AT"): "i", ("AT", "A"): "i", ("A", "."): "r", ("A", "A"): "r", ("A", "<DEL>"): "u", ("A", "A[2:5["): "b", ("A", ".A"): "b", ("AT", "CGG"): "o"}
    rows = spark.createDataFrame(list(cases), "ref string, alt string").select("ref", "alt", event_type(F.col("ref"), F.col("alt")).alias("t")).collect()
    assert {(r.ref, r.alt): r.t for r in rows} == cases
    n = spark.createDataFrame([("TCAA", "TCA")], "ref string, alt string").select(normalize_alleles(F.col("ref"), F.col("alt")).alias("n")).first().n
    assert len(n.ref) - len(n.alt) == 1


def test_sequence_operators(spark, cohort):
    ref = spark.createDataFrame([("1", 1, "AAAAAAAAAA"), ("1", 11, "CCCCCCCCCC"), ("1", 21, "GGGGGGGGGGAT")], "chrom string, start int, seq string")
    flank = {r.pos: r.flank for r in sequence.flanks(cohort, ref, 3).collect()}
    assert flank[10] == "AAA[A/G]CCC"
    text = {r.start: r.seq for r in sequence.consensus(cohort, ref).collect()}
    assert text[1] == "AAAAAAAAAG"


def test_side_tables(spark, tmp_path):
    (tmp_path / "b.bed").write_text("chrom start end\n1\t5\t9\nX 1 2\n")
    assert [tuple(r) for r in side.intervals(spark, f"file://{tmp_path}/b.bed").collect()] == [("1", 5, 9), ("X", 1, 2)]
    (tmp_path / "m.fa").write_text(">1 x\n0011\n22\n>2\n9\n")
    assert sorted(tuple(r) for r in side.mask(spark, f"file://{tmp_path}/m.fa").collect()) == [("1", 1, "0011"), ("1", 5, "22"), ("2", 1, "9")]


def test_validator_and_private_alleles(spark, cohort):
    found = {(r.rule, r.detail) for r in records.validate(cohort, {"DP"}, {"q10"}).collect()}
    assert ("undeclared_info", "DB") in found and ("undeclared_filter", "a1") in found
    private = {r.pos for r in records.subset(cohort, spark.createDataFrame([("C",)], "sample_id string"), private=True).collect()}
    assert private == set()


def test_homozygous_runs_find_a_long_run(spark):
    from locusframe.schema import Cohort

    n = 400
    sites = spark.createDataFrame([(i, "1", 1 + i * 200_000, "A", ["C"], i) for i in range(n)], "site_id long, chrom string, pos int, ref string, alt array<string>, line_no long")
    calls = [(i, s, 0, int(s != "hom" or i < 100) * ((i + k) % 2), 2, True) for i in range(n) for k, s in enumerate(("hom", "x", "y", "z"))]
    calls = spark.createDataFrame(calls, "site_id long, sample_id string, a1 int, a2 int, ploidy int, included boolean").selectExpr("*", "true AS phased")
    samples = spark.createDataFrame([("hom", 0), ("x", 1), ("y", 2), ("z", 3)], "sample_id string, sample_idx int")
    runs = individual.homozygous_runs(Cohort(sites, calls, samples)).collect()
    assert {r.sample_id for r in runs} == {"hom"} and max(r.n_variants for r in runs) > 250


def test_thinning_by_blocks_is_the_greedy_walk(spark):
    import random

    rng = random.Random(8)
    for n, far, distance in ((400, 3000, 1), (400, 3000, 7), (400, 900, 60), (60, 40000, 900), (300, 300, 5000)):
        rows = [(i, c, rng.randint(1, far), i) for i, c in enumerate("12" * n)]
        sites = spark.createDataFrame(rows, "site_id long, chrom string, pos int, line_no long")
        want = set()
        for chrom in "12":
            last = None
            for p, i in sorted((p, i) for i, c, p, _ in rows if c == chrom):
                if last is None or p - last >= distance:
                    want.add(i)
                    last = p
        for width in (1, 500):
            assert {r.site_id for r in filters.thin(sites, distance, width).collect()} == want


def test_leading_components_equal_numpy(spark, monkeypatch):
    import numpy as np

    from locusframe.schema import CALLS, SAMPLES, SITES, Cohort

    rng = np.random.default_rng(3)
    freq = np.stack([rng.uniform(0.1, 0.9, 80), rng.uniform(0.1, 0.9, 80), rng.uniform(0.1, 0.9, 80)])
    g = np.stack([(rng.random((80, 2)) < freq[k % 3][:, None]).astype(int) for k in range(30)], axis=1)
    sites = spark.createDataFrame([(i, "1", i + 1, None, "A", ["C"], None, [], {}, ".", ["GT"], i) for i in range(80)], SITES)
    calls = spark.createDataFrame([(i, f"s{k:02d}", int(g[i, k, 0]), int(g[i, k, 1]), 2, False, None, None, [], None, True) for i in range(80) for k in range(30)], CALLS)
    c = Cohort(sites, calls, spark.createDataFrame([(f"s{k:02d}", k) for k in range(30)], SAMPLES))
    x = g.sum(axis=2).astype(float)
    x = x[(x.sum(axis=1) > 0) & (x.sum(axis=1) < 60)]
    p = x.sum(axis=1, keepdims=True) / 60
    m = (x - 2 * p) / np.sqrt(p * (1 - p))
    values, vectors = np.linalg.eigh(m.T @ m / len(m))
    monkeypatch.setattr(individual, "MAX_SAMPLES", 10)
    got = individual.principal_components(c, k=2).collect()
    assert len(got) == 60
    for k in (1, 2):
        mine = np.array([r.value for r in sorted((r for r in got if r.component == k), key=lambda r: r.sample_id)])
        assert abs(next(r.eigenvalue for r in got if r.component == k) - values[-k]) < 1e-6 and abs(abs(mine @ vectors[:, -k]) - 1) < 1e-5 and mine[np.abs(mine).argmax()] > 0


def test_streaming_counts(spark, tmp_path):
    from locusframe.streaming.incremental import allele_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(ROWS[:2]) + "\n")
    lines = spark.readStream.text(f"file://{tmp_path}/in")
    q = allele_counts(lines).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    got = {(r.pos, r.allele_idx): r["count"] for r in spark.table("counts").collect()}
    q.stop()
    assert got[10, 1] == 3 and got[15, 2] == 3


def test_windowed_statistics_skip_nothing(cohort):
    assert sum(r.n_variants for r in windows.snp_density(cohort, 10).collect()) == 4


VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
1\t10\t.\tA\tC\t30.5\tPASS\tDP=3\tGT:AD:GQ\t0/1:3,4:.\t1|1:0,9:120
1\t10\t.\tA\tG\t.\t.\t.\tGT\t./.\t0/1
1\t20\trs1\tAC\tA,G\t7.0\tq10;s50\tDB\tGT:PL\t1|2:1,2,3\t0/0:.
"""


def test_files_come_back_as_they_were(spark, tmp_path):
    import gzip

    from locusframe.operators import filters
    from locusframe.operators.filters import Filters
    from locusframe.sources import vcf

    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(VCF)
    c = vcf.read(spark, f"file://{tmp_path}/a.vcf.gz")
    gq = {(r.site_id, r.sample_id): r.gq for r in c.calls.collect()}
    assert sorted(v for v in gq.values() if v is not None) == [99.0] and len(gq) == 6
    kept = filters.apply(c, Filters(min_gq=20.0)).calls.filter("included").collect()
    assert [(r.sample_id, r.gq) for r in kept] == [("s2", 99.0)]
    body = [x for x in VCF.splitlines() if not x.startswith("#")]
    assert [r.value for r in vcf.lines(c).collect()] == [x.replace("DB", "DB=1") for x in body]
    vcf.write(c, f"file://{tmp_path}/out")
    again = vcf.read(spark, f"file://{tmp_path}/out/*")
    assert sorted(r.value for r in vcf.lines(again).collect()) == sorted(x.replace("DB", "DB=1") for x in body)


def test_a_file_without_samples_keeps_its_records(spark, tmp_path):
    from locusframe.sources import vcf

    rows = ["\t".join(x.split("\t")[:8]) for x in VCF.splitlines() if not x.startswith("##")]
    (tmp_path / "s.vcf").write_text("\n".join(["##fileformat=VCFv4.2", *rows]) + "\n")
    c = vcf.read(spark, f"file://{tmp_path}/s.vcf")
    assert c.samples.count() == 0 and [r.value for r in vcf.lines(c).collect()] == [x.replace("DB", "DB=1") for x in rows[1:]]


def test_consensus_equals_brute_force(spark):
    import random

    from locusframe.operators import sequence
    from locusframe.schema import SAMPLES, CALLS, SITES, Cohort

    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(200))
    variants = []
    for i, pos in enumerate(sorted(rng.sample(range(1, 198), 45))):
        ref = text[pos - 1 : pos - 1 + rng.choice([1, 1, 2, 3, 25])]
        variants.append((i, pos, ref, rng.choice(["T", "GG", ref[0], "ACGTA"])))
    sites = spark.createDataFrame([(i, "c", p, None, r, [a], None, [], {}, ".", ["GT"], i) for i, p, r, a in variants], SITES)
    cohort = Cohort(sites, spark.createDataFrame([], CALLS), spark.createDataFrame([], SAMPLES))
    chunks = spark.createDataFrame([("c", k + 1, text[k : k + 10]) for k in range(0, 200, 10)], "chrom string, start int, seq string")
    want, at = "", 0
    for _, p, r, a in variants:
        if p - 1 >= at:
            want, at = want + text[at : p - 1] + a, p - 1 + len(r)
    want += text[at:]
    got = "".join(r.seq for r in sequence.consensus(cohort, chunks).orderBy("start").collect())
    assert got == want


def test_merge_numbers_alleles_anew_and_keeps_the_first_info(spark):
    from locusframe.operators import sets
    from locusframe.schema import SAMPLES, CALLS, SITES, Cohort

    def one(ref, alt, info, gts, names, qual):
        site = spark.createDataFrame([(0, "1", 5, None, ref, alt, qual, ["PASS"], info, ".", ["GT"], 0)], SITES)
        calls = spark.createDataFrame([(0, n, a, b, 2, False, None, None, [], None, True) for n, (a, b) in zip(names, gts)], CALLS)
        return Cohort(site, calls, spark.createDataFrame([(n, i) for i, n in enumerate(names)], SAMPLES))

    a = one("A", ["G"], {"X": "1"}, [(0, 1), (None, None)], ["s", "t"], 10.0)
    b = one("AC", ["T", "GC"], {"X": "2", "Y": "3"}, [(1, 2)], ["s"], 40.0)
    r = sets.merge_records([a, b]).first()
    assert (r.ref, r.alt, r["info"], r.an, r.ac, r.genotypes) == ("AC", "GC,T", "X=1;Y=3", 4, "2,1", "1_s=0/1 2_s=2/1")
    assert sets.merge([a, b]).first().qual == 20.0
    none = one("A", ["G"], {}, [], [], 7.0)
    assert sets.merge([none, none]).first().qual == 7.0


def test_principal_components_equal_numpy(spark):
    import numpy as np

    from locusframe.operators import individual
    from locusframe.schema import SAMPLES, CALLS, SITES, Cohort

    rng = np.random.default_rng(2)
    g = rng.integers(0, 2, (40, 5, 2))
    g[:, 3] = g[:, 4]
    sites = spark.createDataFrame([(i, "1", i + 1, None, "A", ["C"], None, [], {}, ".", ["GT"], i) for i in range(40)], SITES)
    calls = spark.createDataFrame([(i, f"s{k}", int(g[i, k, 0]), int(g[i, k, 1]), 2, False, None, None, [], None, True) for i in range(40) for k in range(5)], CALLS)
    c = Cohort(sites, calls, spark.createDataFrame([(f"s{k}", k) for k in range(5)], SAMPLES))
    x = g.sum(axis=2).astype(float)
    x = x[(x.sum(axis=1) > 0) & (x.sum(axis=1) < 10)]
    p = x.sum(axis=1, keepdims=True) / 10
    m = (x - 2 * p) / np.sqrt(p * (1 - p))
    values, vectors = np.linalg.eigh(m.T @ m / len(m))
    got = {(r.sample_id, r.component): (r.eigenvalue, r.value) for r in individual.principal_components(c).collect()}
    for k in range(5):
        mine = np.array([got[f"s{i}", k + 1][1] for i in range(5)])
        assert abs(got["s0", k + 1][0] - values[::-1][k]) < 1e-9 and (values[::-1][k] < 1e-9 or abs(abs(mine @ vectors[:, ::-1][:, k]) - 1) < 1e-6)
    first = np.array([got[f"s{i}", 1][1] for i in range(5)])
    loads = sorted(r.loading for r in individual.loadings(c, 1).collect())
    assert np.allclose(loads, sorted(m @ first / (first @ first)))


def test_merge_collapses_kinds_and_sums_counts(spark):
    from locusframe.operators import sets
    from locusframe.schema import SAMPLES, CALLS, SITES, Cohort

    def one(*rows):
        sites = spark.createDataFrame([(i, "1", 5, None, r, [a], None, [], info, ".", [], i) for i, (r, a, info) in enumerate(rows)], SITES)
        return Cohort(sites, spark.createDataFrame([], CALLS), spark.createDataFrame([], SAMPLES))

    a, b = one(("A", "G", {"DP": "3", "DP4": "1,2"})), one(("A", "T", {"DP": "4", "DP4": "3,4"}), ("AC", "A", {}))
    got = lambda how: sorted((r.ref, r.alt, r["info"]) for r in sets.merge([a, b], how).collect())
    assert got("snps") == got("both") == [("A", "G,T", "DP=7;DP4=4,6"), ("AC", "A", ".")]
    assert got("none") == got("indels") == [("A", "G", "DP=3;DP4=1,2"), ("A", "T", "DP=4;DP4=3,4"), ("AC", "A", ".")]
    assert got("any") == [("AC", "GC,TC,A", "DP=7;DP4=4,6")]


def test_records_are_normalised_ruled_and_validated(spark, cohort, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(10, "CAGT", ["CGT"], {"DP": "4", "DP4": "1,1,0,1", "PV4": "0.5,0.001,1,1"}, 9.0)], "pos int, ref string, alt array<string>, info map<string,string>, qual double").withColumn("filter", F.array(F.lit("PASS")))
    r = records.normalise(rows).first()
    assert (r.pos, r.ref, r.alt) == (10, "CA", ["C"])
    named = records.named_filters(rows, records.local_rules(MinDP=5, MinAB=2, Qual=5, BaseQualBias=0.01, StrandBias=0.01, RefN=0, MinMQ=10)).first()
    assert named["filter"] == ["BaseQualBias", "MinAB", "MinDP"]
    f = tmp_path / "v.vcf"
    head = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', '##INFO=<ID=AN,Number=1,Type=Integer,Description="n">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta"]
    f.write_text("\n".join([*head, "1\t1\t.\tA\tC\t.\t.\tDP=x;AF=0.1,0.2;AN=3\tGT\t0/1", "1\t2\t.\tA\tC\t.\t.\tDP=4;AF=0.1;AN=2\tGT\t0/1"]) + "\n")
    assert sorted((r.rule, r.detail) for r in records.validate(vcf.read(spark, f"file://{f}")).collect()) == [("bad_an_ac", "3"), ("bad_number", "AF=0.1,0.2"), ("bad_type", "DP=x")]
    listed = vcf.from_positions(spark.createDataFrame([("1", 10), ("1", 99)], "chrom string, pos int"))
    from locusframe.operators import sets

    assert [r.pos for r in sets.intersect([cohort, listed], least=2).select("pos").collect()] == [10]
    (tmp_path / "c.txt").write_text("##contig=<ID=1>\n##contig=<ID=X>\n")
    assert len(side.contigs(spark, f"file://{tmp_path}/c.txt")) == 2


def test_runs_of_homozygosity_equal_a_plain_forward_backward(spark):
    from math import exp

    from locusframe.schema import SAMPLES, CALLS, SITES, Cohort

    rng = __import__("random").Random(5)
    n, own = 120, {}
    for i in range(n):
        for k in range(6):
            run = k == 2 and 30 <= i < 90
            own[i, k] = (0, 0) if run else (rng.randint(0, 1), rng.randint(0, 1))
    pos = [1000 * (i + 1) for i in range(n)]
    sites = spark.createDataFrame([(i, "1", pos[i], None, "A", ["C"], None, [], {}, ".", ["GT"], i) for i in range(n)], SITES)
    calls = spark.createDataFrame([(i, f"s{k}", *own[i, k], 2, False, None, None, [], None, True) for i in range(n) for k in range(6)], CALLS)
    cohort = Cohort(sites, calls, spark.createDataFrame([(f"s{k}", k) for k in range(6)], SAMPLES))
    got, cut = individual.homozygous_runs(cohort).collect(), individual.homozygous_runs(cohort, width=7000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cut))  # stretches of seven sites
    want = []
    for k in range(6):
        used = [i for i in range(n) if any(1 in own[i, j] for j in range(6))]
        rate = [sum(own[i, j][0] != own[i, j][1] for j in range(6)) / 6 for i in used]
        emit = [[(0.01, h) if own[i, k][0] != own[i, k][1] else (0.99, 1 - h)] for i, h in zip(used, rate)]
        f = [[emit[0][0][0] * 0.05, emit[0][0][1] * 0.95]]
        move = [1 - exp(-8 * (pos[b] - pos[a]) / 1e8) for a, b in zip(used, used[1:])]
        step = lambda e: ((1 - 0.95 * e, 0.95 * e), (0.05 * e, 1 - 0.05 * e))
        for t, e in enumerate(move, 1):
            m = step(e)
            f.append([emit[t][0][y] * sum(f[-1][x] * m[x][y] for x in (0, 1)) for y in (0, 1)])
            f[-1] = [v / sum(f[-1]) for v in f[-1]]
        b = [[1.0, 1.0]]
        for t in range(len(used) - 2, -1, -1):
            m = step(move[t])
            b.insert(0, [sum(m[x][y] * emit[t + 1][0][y] * b[0][y] for y in (0, 1)) for x in (0, 1)])
            b[0] = [v / sum(b[0]) for v in b[0]]
        inside = [x[0] * y[0] / (x[0] * y[0] + x[1] * y[1]) > 0.99 for x, y in zip(f, b)]
        start = None
        for t, ok in enumerate([*inside, False]):
            if ok and start is None:
                start = t
            elif not ok and start is not None:
                want.append((f"s{k}", pos[used[start]], pos[used[t - 1]], t - start))
                start = None
    assert sorted((r.sample_id, r.auto_start, r.auto_end, r.n_variants) for r in got) == sorted(want) and any(w[0] == "s2" for w in want)


def test_pieces_are_joined_by_the_likelier_phase(spark):
    left = spark.createDataFrame([("s", "1", p, 0, 1) for p in range(1, 11)] + [("t", "1", 3, 0, 1)], "sample_id string, chrom string, pos int, a1 int, a2 int")
    right = spark.createDataFrame([("s", "1", p, 1, 0) for p in range(6, 16)] + [("t", "1", 12, 1, 0), ("u", "1", 12, 1, 0)], "sample_id string, chrom string, pos int, a1 int, a2 int")
    got = {(r.sample_id, r.pos): (r.a1, r.a2, r.ps) for r in records.joined_calls(left, right).collect()}
    assert all(got["s", p] == (0, 1, 1) for p in range(1, 16)) and got["t", 12] == (1, 0, 12) and got["t", 3] == (0, 1, 3) and got["u", 12] == (1, 0, 12) and len(got) == 18


def test_haplotypes_are_the_consensus_of_each_copy(spark, cohort):
    ref = spark.createDataFrame([("1", 1, "ACGTACGTAA"), ("1", 11, "GGGGCGGGGG"), ("1", 21, "ACGTACGTAC"), ("1", 31, "ATCC"), ("X", 31, "ACGTACGTAT")], "chrom string, start int, seq string")
    phased = cohort.with_(calls=cohort.calls.withColumn("phased", __import__("pyspark").sql.functions.lit(True)))
    got = {}
    for r in sequence.haplotypes(phased, ref).collect():
        got.setdefault((r.sample_id, r.copy), set()).add((r.chrom, r.start, r.seq))
    assert len(got) == 8
    for (name, copy), rows in got.items():
        assert rows == {(r.chrom, r.start, r.seq) for r in sequence.consensus(phased, ref, name, copy).collect()}
    assert ("1", 1, "ACGTACGTAG") in got["C", 2] and ("1", 11, "GGGGGGGGGG") in got["B", 2] and ("1", 31, "ACC") in got["D", 1]
