"""Header and FORMAT checks, query templates, switch errors by sample."""

import random

from locusframe.operators import compare, export, records
from locusframe.schema import CALLS, SAMPLES, SITES, Cohort
from locusframe.sources import side, vcf


def make(spark, path, head, rows=()):
    path.write_text("\n".join([*head, *("\t".join(r) for r in rows)]) + "\n")
    return vcf.read(spark, str(path))


COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"


def test_header_rules(spark, tmp_path):
    good = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d, x">', '##FILTER=<ID=q,Description="f">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p">', COLUMNS]
    assert records.validate_header(make(spark, tmp_path / "a", good)).collect() == []
    bad = ['##INFO=<ID=DP,Number=X,Type=Int,Description="d">', "##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer>', '##FORMAT=<ID=F,Number=1,Type=Flag,Description="f">', "##FILTER=<ID=q>", COLUMNS.replace("REF\tALT", "ALT\tREF") + "\tA"]
    got = sorted((r.line_no, r.rule, r.detail) for r in records.validate_header(make(spark, tmp_path / "b", bad)).collect())
    assert got == [
        (1, "bad_declared_number", "X"), (1, "bad_declared_type", "Int"), (2, "fileformat_not_first", "##fileformat=VCFv4.2"), (3, "declared_twice", "DP"), (3, "missing_key", "INFO:Description"),
        (4, "bad_declared_type", "Flag"), (5, "missing_key", "FILTER:Description"), (6, "bad_columns", "#CHROM POS ID ALT REF QUAL FILTER INFO FORMAT"), (6, "sample_twice", "A"),
    ]
    none = records.validate_header(make(spark, tmp_path / "a", good).with_(header=[])).collect()
    assert [r.rule for r in none] == ["no_fileformat", "no_columns"]


def test_format_rules(spark, tmp_path):
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">', '##FORMAT=<ID=AF,Number=A,Type=Float,Description="f">', COLUMNS]
    c = make(spark, tmp_path / "a", head, [
        ["1", "1", ".", "A", "C", ".", ".", ".", "GT:PL:AD:AF", "0/1:1,2,3:1,2:0.5", "1:1,2:3,4:."], ["1", "2", ".", "A", "C,G", ".", ".", ".", "PL:GT:XX", "1,2,3:0/1:x", "1,2,3,4,5,6:1/1:y"],
        ["1", "3", ".", "A", "C", ".", ".", ".", "GT:AF:AD", "0/1:x:1,y", "0/1:0.1,0.2:1"],
    ])
    at = {r.line_no: r.pos for r in c.sites.collect()}
    got = sorted((at[r.line_no], r.rule, r.detail) for r in records.validate_calls(c).collect())
    assert got == [
        (2, "bad_format_number", "A:PL=1,2,3"), (2, "gt_not_first", "PL:GT:XX"), (2, "undeclared_format", "XX"), (3, "bad_format_number", "B:AD=1"), (3, "bad_format_number", "B:AF=0.1,0.2"), (3, "bad_format_type", "A:AD=1,y"), (3, "bad_format_type", "A:AF=x"),
    ]


def test_templates(spark, tmp_path):
    c = make(spark, tmp_path / "a", ["##fileformat=VCFv4.2", COLUMNS], [["1", "7", ".", "A", "C,G", ".", "PASS", "AC=3,4;DB", "GT:PL:DP", "0/1:9,8,7:5", "2|2:.:."]])
    line = lambda t: export.template(c, t).first().line
    assert line(r"%CHROM\t%POS %INFO/AC[1] %INFO/AC[2] %INFO/AC %INFO/NO;%INFO") == "1\t7 4 . 3,4 .;AC=3,4;DB=1"
    assert line(r"%POS[ %SAMPLE=%GTR:%PL[2]:%DP:%XX]|[%GT,]%QUAL") == "7 A=0/1:7:5:. B=2|2:.:.:.|A/C,G|G,."
    assert line("%LINE") == "1\t7\t.\tA\tC,G\t.\tPASS\tAC=3,4;DB=1\tGT:PL:DP\t0/1:9,8,7:5\t2|2:.:."


def test_ambiguity_codes(spark, tmp_path):
    c = make(spark, tmp_path / "a", ["##fileformat=VCFv4.2", COLUMNS], [["1", str(i), ".", r, a, ".", ".", ".", "GT", g, "./."] for i, (r, a, g) in enumerate([("A", "C", "0/1"), ("A", "G", "1|0"), ("T", "A,C", "0/1"), ("C", "G", "0/1"), ("C", "T", "0/1"), ("G", "T", "0/1"), ("G", "T", "1/1"), ("G", "GT", "0/1")])])
    assert [r.calls.split("\t")[0] for r in export.to_tab(c, iupac=True).orderBy("pos").collect()] == ["M", "R", "W", "S", "Y", "K", "T", "G/GT"]


def test_sequences_and_masks(spark, tmp_path):
    lines = [">a first", *["ACGT" * 5] * 30, "AC", ">b", "GG", ">c", ">d", "TTTT", "T"]
    (tmp_path / "f.fa").write_text("junk\n" + "\n".join(lines) + "\n\n")
    got = sorted(tuple(r) for r in side.sequences(spark, str(tmp_path / "f.fa")).collect())
    assert got == sorted([("a", 1 + 20 * i, "ACGT" * 5) for i in range(30)] + [("a", 601, "AC"), ("b", 1, "GG"), ("d", 1, "TTTT"), ("d", 5, "T")])


def test_switches_by_sample(spark):
    rng = random.Random(4)
    n, samples = 200, ["a", "b", "c"]
    sites = spark.createDataFrame([(i, "12"[i % 2], 1 + 3000 * i, None, "A", ["C"], None, [], {}, ".", ["GT"], i) for i in range(n)], SITES)
    gts = [{(i, s): rng.choice([(0, 1), (1, 0), (0, 0), (None, 1)]) for i in range(n) for s in samples} for _ in range(2)]
    make_ = lambda g: Cohort(sites, spark.createDataFrame([(i, s, a, b, 2, rng.random() < 0.9, None, None, [], None, True) for (i, s), (a, b) in g.items()], CALLS), spark.createDataFrame([(s, k) for k, s in enumerate(samples)], SAMPLES))
    one, two = make_(gts[0]), make_(gts[1])
    phased = [{(r.site_id, r.sample_id): r.phased for r in c.calls.collect()} for c in (one, two)]
    want, spans = {}, []
    for s in samples:
        hets = switches = 0
        for chrom in "12":
            last = None
            for i in range(n):
                if "12"[i % 2] != chrom:
                    continue
                g, h = gts[0][i, s], gts[1][i, s]
                if None in g or None in h or g[0] == g[1] or sorted(g) != sorted(h) or not (phased[0][i, s] and phased[1][i, s]):
                    continue
                hets += 1
                if last is not None and last[1] != (g == h):
                    switches += 1
                    spans.append((chrom, last[0], 1 + 3000 * i, s))
                last = (1 + 3000 * i, g == h)
        want[s] = (hets, switches, switches / hets)
    assert {r.sample_id: (r.n_het, r.n_switch, r.rate) for r in compare.switch_summary(one, two).collect()} == want
    assert sorted(tuple(r) for r in compare.switch_errors(one, two).collect()) == sorted(spans)
