"""Fields listed by allele or genotype under new allele numbers: merges, subsets, ploidy, likelihoods of cases and controls."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import fields
from locusframe.operators import merging, records
from locusframe.sources import vcf

HEAD = [
    "##fileformat=VCFv4.2", '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', '##INFO=<ID=AD,Number=R,Type=Integer,Description="d">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="d">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p">', '##FORMAT=<ID=EC,Number=A,Type=Integer,Description="e">',
]


def make(spark, path, samples, rows):
    path.write_text("\n".join([*HEAD, "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + samples), *("\t".join(r) for r in rows)]) + "\n")
    return vcf.read(spark, str(path))


def plain(text, number, back, n_old):
    if text in (None, "."):
        return text
    x = text.split(",")
    take = lambda i: x[i] if i is not None and 0 <= i < len(x) else "."
    if number == "A":
        out = [take(b - 1) if b is not None else "." for b in back[1:]]
    elif number == "R" or len(x) == n_old and n_old > 1:
        out = [take(b) for b in back]
    elif len(x) == n_old * (n_old + 1) // 2:
        place = {p: k for k, p in enumerate((i, j) for i in range(n_old) for j in range(i + 1))}
        out = []
        for i in range(len(back)):
            for j in range(i + 1):
                a, b = back[i], back[j]
                out.append(x[place[max(a, b), min(a, b)]] if a is not None and b is not None else ".")
    else:
        out = ["."]
    return ",".join(out) or "."


def test_reindexed_lists(spark):
    rng, rows = random.Random(4), [("G", ".", [0, 1], 2), ("A", None, [0], 1), ("G", "1,2", [0, None, 1], 3)]
    for _ in range(300):
        n, number = rng.randint(1, 4), rng.choice("ARG")
        count = {"A": n - 1, "R": n, "G": rng.choice([n, n * (n + 1) // 2])}[number]
        if not count:
            continue
        back = [0, *(rng.choice([None, *range(1, n)]) for _ in range(rng.randint(0, 4)))]
        rows.append((number, ",".join(str(rng.randint(0, 99)) for _ in range(count)), back, n))
    df = spark.createDataFrame(rows, "number string, text string, back array<int>, n int")
    out = F.lit(None).cast("string")
    for k in "ARG":
        out = F.when(F.col("number") == k, fields.reindexed(F.col("text"), k, F.col("back"), F.col("n"))).otherwise(out)
    for r in df.withColumn("out", out).collect():
        assert r.out == plain(r.text, r.number, r.back, r.n), r


def test_a_merge_of_three_alleles(spark, tmp_path):
    one = make(spark, tmp_path / "a.vcf", ["P", "Q"], [
        ["1", "5", "rs1", "A", "C", "30", "PASS", "AC=1;AN=4;AF=0.25;AD=7,3;DP=10", "GT:PL:AD:EC", "0/1:10,0,20:4,2:8", "0/0:0,5,50:3,1:9"],
        ["1", "9", ".", "G", "T", "10", "q1", "AF=0.5", "GT", "1|1", "./."],
    ])
    two = make(spark, tmp_path / "b.vcf", ["R", "Q"], [
        ["1", "5", ".", "AT", "GT,CT", "60", "PASS", "AC=1,2;AN=4;AF=0.1,0.9;AD=1,2,3;DP=5;X=y", "GT:AD:PL", "1/2:1,5,6:9,8,7,6,0,4", "2/2:0,0,9:1,2,3,4,5,0"],
        ["2", "3", ".", "C", "T", ".", ".", ".", "GT", "0", "1"],
    ])
    got = merging.merged_cohort([one, two])
    assert [r.sample_id for r in got.samples.orderBy("sample_idx").collect()] == ["P", "1_Q", "R", "2_Q"]
    s = {(r.chrom, r.pos): r for r in got.sites.collect()}
    x = s["1", 5]
    assert (x.ref, x.alt, x.id, x.qual, x["filter"], x.format) == ("AT", ["CT", "GT"], "rs1", 45.0, ["PASS"], ["GT", "PL", "AD", "EC"])
    # alleles of the calls: 0/1, 0/0 (of A and C), 1/2 (of G and C), 2/2 (of C)
    assert x.info == {"AN": "8", "AC": "4,1", "AF": "0.25,0.1", "AD": "7,3,2", "DP": "15", "X": "y", "SF": "0,1"}
    c = {(r.site_id, r.sample_id): r for r in got.calls.collect()}
    cell = lambda name, key: c[x.site_id, name].fmt[key]
    assert (c[x.site_id, "R"].a1, c[x.site_id, "R"].a2) == (2, 1) and (c[x.site_id, "2_Q"].a1, c[x.site_id, "2_Q"].a2) == (1, 1)
    assert cell("P", "PL") == "10,0,20,.,.,." and cell("P", "AD") == "4,2,." and cell("P", "EC") == "8,."
    # R: AA AG GG AC GC CC = 9 8 7 6 0 4; new order AA AC CC AG CG GG
    assert cell("R", "PL") == "9,6,4,8,0,7" and cell("R", "AD") == "1,6,5" and cell("2_Q", "PL") == "1,4,0,2,5,3"
    y = s["1", 9]
    assert y.info == {"AN": "2", "AC": "2", "AF": "0.5", "SF": "0f"} and y["filter"] == ["q1"] and c[y.site_id, "R"].a1 is None and c[y.site_id, "R"].ploidy == 2
    assert s["2", 3].info == {"AN": "2", "AC": "1", "SF": "1"} and c[s["2", 3].site_id, "2_Q"].ploidy == 1
    assert len(c) == 12
    vcf.write(got, str(tmp_path / "out"))
    back = vcf.read(spark, str(tmp_path / "out"))
    assert back.sites.count() == 3 and {r.fmt["PL"] for r in back.calls.filter("fmt['PL'] is not null").collect()} >= {"9,6,4,8,0,7", "10,0,20,.,.,."}


def test_records_of_one_input_at_one_position_stay_apart(spark, tmp_path):
    one = make(spark, tmp_path / "a.vcf", ["P"], [["1", "5", ".", "A", "C", ".", ".", ".", "GT", "0/1"], ["1", "5", ".", "A", "G", ".", ".", ".", "GT", "1/1"]])
    two = make(spark, tmp_path / "b.vcf", ["R"], [["1", "5", ".", "A", "T", ".", ".", ".", "GT", "0/1"]])
    got = merging.merged_cohort([one, two])
    assert sorted(tuple(r.alt) for r in got.sites.collect()) == [("C", "T"), ("G",)] and got.calls.count() == 4


def test_inputs_without_samples_sum_their_counts(spark, tmp_path):
    rows = lambda alt, info: [["1", "5", ".", "A", alt, ".", ".", info]]
    text = lambda p, r: (p.write_text("\n".join([*HEAD, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", *("\t".join(x) for x in r)]) + "\n"), vcf.read(spark, str(p)))[1]
    got = merging.merged_cohort([text(tmp_path / "a", rows("C", "AC=3;AN=8")), text(tmp_path / "b", rows("G,C", "AC=1,2;AN=6")), text(tmp_path / "c", rows("G", "."))])
    assert got.sites.first().info == {"AN": "14", "AC": "5,1", "SF": "0,1,2"}


def test_a_subset_trims_alleles_and_lists(spark, tmp_path):
    c = make(spark, tmp_path / "a.vcf", ["P", "Q"], [
        ["1", "5", ".", "A", "C,G,T", ".", ".", "AF=0.1,0.2,0.3;AC=9,9,9;AN=99", "GT:PL:AD", "0/3:0,1,2,3,4,5,6,7,8,9:1,2,3,4", "1/2:9,8,7,6,5,4,3,2,1,0:5,6,7,8"],
        ["1", "7", ".", "A", "C", ".", ".", "AF=0.5", "GT", "0/0", "0/1"],
    ])
    got = merging.subset_cohort(c, c.samples.filter("sample_id = 'P'"))
    s = {r.pos: r for r in got.sites.collect()}
    calls = {r.site_id: r for r in got.calls.collect()}
    assert s[5].alt == ["T"] and s[5].info == {"AF": "0.3", "AN": "2", "AC": "1"} and s[7].alt == [] and s[7].info == {"AF": ".", "AN": "2"}
    assert (calls[s[5].site_id].a1, calls[s[5].site_id].a2) == (0, 1) and calls[s[5].site_id].fmt["PL"] == "0,6,9" and calls[s[5].site_id].fmt["AD"] == "1,4"
    assert [r.pos for r in merging.subset_cohort(c, c.samples.filter("sample_id = 'Q'"), private=True).sites.orderBy("pos").collect()] == [5, 7]
    whole = merging.subset_cohort(c, c.samples.filter("sample_id = 'Q'"), trim=False).sites.filter("pos = 5").first()
    assert whole.alt == ["C", "G", "T"] and whole.info["AC"] == "1,1,0"


def test_ploidy_with_likelihoods(spark, tmp_path):
    c = make(spark, tmp_path / "a.vcf", ["M1", "F1"], [
        ["X", "5", ".", "A", "C", ".", ".", ".", "GT:PL", "0/1:30,0,10", "0/1:30,0,10"],
        ["X", "6", ".", "A", "C,G", ".", ".", ".", "GT:PL", "0/0:9,1,8,1,1,7", "0:9,3,7"],
        ["X", "7", ".", "A", "C", ".", ".", ".", "GT", "1/0", "1"],
        ["Y", "5", ".", "A", "C", ".", ".", ".", "GT:PL", "0/1:5,0,9", "0/1:30,0,10"],
        ["Y", "6", ".", "A", "C", ".", ".", ".", "GT", "./.", "./."],
    ])
    regions = spark.createDataFrame([("X", 0, 100, "M", 1), ("X", 0, 100, "F", 2), ("Y", 0, 100, "M", 1), ("Y", 0, 100, "F", 0)], "chrom string, start int, end int, sex string, ploidy int")
    sexes = spark.createDataFrame([("M1", "M"), ("F1", "F")], "sample_id string, sex string")
    at = {r.site_id: (r.chrom, r.pos) for r in c.sites.collect()}
    got = {(*at[r.site_id], r.sample_id): r for r in records.fix_ploidy(c, regions, sexes, likelihoods=True).collect()}
    cell = lambda *k: (got[k].a1, got[k].a2, got[k].ploidy, (got[k].fmt or {}).get("PL"))
    assert cell("X", 5, "M1") == (1, None, 1, "30,10") and cell("X", 5, "F1") == (0, 1, 2, "30,0,10")
    assert cell("X", 6, "M1") == (2, None, 1, "9,8,7") and cell("X", 6, "F1") == (1, 1, 2, "9,.,3,.,.,7")
    assert cell("X", 7, "M1") == (1, None, 1, None) and cell("X", 7, "F1") == (1, 1, 2, None)
    assert cell("Y", 5, "M1") == (0, None, 1, "5,9") and cell("Y", 5, "F1") == (None, None, 1, "30,10") and cell("Y", 6, "F1")[:3] == (None, None, 2)
    simple = {(*at[r.site_id], r.sample_id): r for r in records.fix_ploidy(c, regions, sexes).collect()}
    assert (simple["X", 5, "M1"].a1, simple["Y", 5, "F1"].a1, simple["Y", 5, "F1"].ploidy) == (0, None, 1)


def contrasted(spark, tmp_path, rows, cases=("D",), controls=("A", "B", "C"), **more):
    c = make(spark, tmp_path / "c.vcf", ["A", "B", "C", "D", "E"], [["1", str(i + 1), ".", "A", r[0], ".", ".", ".", r[1], *r[2:]] for i, r in enumerate(rows)])
    found = records.novelty(c, list(cases), list(controls), **more)
    return c, {r.pos: (r.novelty, r.novel_alleles, r.novel_genotypes) for r in found.collect()}


def test_novelty_by_likelihoods(spark, tmp_path):
    rows = [
        ("C", "GT:PL:DP", "0/0:0,40,99:20", "0/0:0,29,99:20", "0/0:0,70,99:20", "0/1:60,0,80:20", "0/0:0,1,2:1"),  # unlike B by 29: both are het at 0 + 29
        ("C", "GT:PL:DP", "0/1:30,0,23:20", "0/1:18,0,15:20", "0/1:55,0,90:20", "0/0:0,42,114:20", "0/0:0,1,2:1"),  # a genotype, not an allele
        ("C", "GT:PL:DP", "0/0:0,40,99:20", "0/0:0,29,99:9", "0/0:0,70,99:20", "0/1:60,0,80:20", "0/0:0,1,2:1"),  # a shallow control
        ("C", "GT:PL:DP", "0/0:0,40,99:20", ".:.:20", "0/0:0,70,99:20", "0/1:60,0,80:20", "0/0:0,1,2:1"),  # an unknown control
        ("C", "GT:PL:DP", "0:0,50:20", "0:0,60:20", "0:0,70:20", "1:44,0:20", "0/0:0,1,2:1"),  # haploid
        ("C,G", "GT:PL:DP", "0/0:0,9,9,9,9,9:20", "0/1:9,0,9,9,9,9:20", "0/0:0,9,9,9,9,9:20", "1/2:9,9,9,9,0,9:20", "0/0:0,1,2,1,1,1:1"),
        ("C", "GT:PL:DP", "0/0:0,9,9:20", "0/0:0,9,9:20", "0/0:0,9,9:20", "0/0:0,5,9:20", "0/0:0,1,2:1"),  # alike
        (".", "GT:DP", "0/0:20", "0/0:20", "0/0:20", "0/0:20", "0/0:20"),
    ]
    c, got = contrasted(spark, tmp_path, rows, min_depth=10)
    assert got == {1: (29, "D", ""), 2: (18, "", "D"), 4: (40, "D", ""), 5: (44, "D", ""), 6: (9, "D", "")}
    marked = {r.pos: r.info for r in records.mark_novel(c, records.novelty(c, ["D"], ["A", "B", "C"], 10)).collect()}
    assert marked[1] == {"NOVELTY": "29", "NOVELAL": "D"} and marked[2] == {"NOVELTY": "15", "NOVELGT": "D"} and marked[3] == {}


def test_novelty_by_genotypes_and_several_cases(spark, tmp_path):
    rows = [
        ("C", "GT", "0/0", "0/0", "./.", "0/1", "0/0"), ("C", "GT", "0/1", "1|0", "0/1", "1/1", "0/1"), ("C", "GT", "./.", ".", "./.", "1/1", "0/1"), ("C,G", "GT", "0/1", "0/1", "0/1", "0/2", "2/2"), ("C", "GT", "0/0", "0/0", "0/0", "./.", "0/0"),
    ]
    _, got = contrasted(spark, tmp_path, rows, cases=("D", "E"))
    assert got == {1: (255, "D", ""), 2: (255, "", "D"), 4: (255, "D,E", "")}


def test_contrast_of_genotypes_knows_shallow_and_unknown_controls(spark, tmp_path):
    """P 0/1 at depth 30 against Q 0/1 at depth 2: nothing to say; a control that is not called says nothing either."""
    c = make(spark, tmp_path / "c.vcf", ["P", "Q", "R"], [["1", str(i), ".", "A", "C", ".", ".", ".", "GT:DP", *x] for i, x in enumerate([("0/1:30", "0/1:2", "0/0:30"), ("0/1:30", "./.:40", "0/0:40"), ("0/1:30", "./.:40", "./.:40"), ("0/1:1", "0/0:40", "0/0:40")])])
    assert [tuple(r) for r in records.contrast(c, ["P"], ["Q", "R"], 10).orderBy("pos").collect()] == [("1", 1, "C", "P"), ("1", 3, "C", "P")]


def test_likeliest_of_every_length(spark):
    rows = [("3,1,2", 2, (1, 0)), ("1,0", 2, (1, 1)), (".", 2, None), ("1,.,2", 2, None), ("1,2,3,4", 2, None), ("5", 1, (0, 0)), ("9,9,9,9,1,9", 3, (2, 1)), (None, 2, None)]
    df = spark.createDataFrame([(t, n) for t, n, _ in rows], "t string, n int")
    got = [(r.x.i, r.x.j) if r.x else None for r in df.select(fields.likeliest(F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == [w for _, _, w in rows]
    order = [(i, j) for i, j in itertools.combinations_with_replacement(range(4), 2)]
    assert [tuple(p) for p in spark.range(1).select(fields.genotypes(F.lit(4)).alias("g")).first().g] == sorted((max(p), min(p)) for p in order)


@pytest.mark.parametrize("name", ["merge", "merge_genotypes", "contrast", "fix_ploidy"])
def test_registered(name):
    from locusframe.plans import catalog

    assert name in catalog.QUERIES and name in catalog.ORACLES


def test_concatenation_with_calls(spark, tmp_path):
    a = make(spark, tmp_path / "a", ["P", "Q"], [["2", "5", ".", "A", "C", ".", ".", ".", "GT", "0/1", "1/1"], ["10", "1", ".", "A", "C", ".", ".", ".", "GT", "0/0", "./."]])
    b = make(spark, tmp_path / "b", ["Q", "P"], [["2", "4", ".", "A", "G", ".", ".", "DP=3", "GT", "0|1", "1|1"], ["3", "1", ".", "A", "T", ".", ".", ".", "GT", "1/1", "0/0"]])
    got = merging.concatenated([a, b])
    vcf.write(got, str(tmp_path / "out"))
    text = [line for f in sorted((tmp_path / "out" / "records").glob("part-*")) for line in f.read_text().splitlines()]
    assert [t.split("\t")[0:2] + t.split("\t")[9:] for t in text] == [["2", "4", "1|1", "0|1"], ["2", "5", "0/1", "1/1"], ["3", "1", "0/0", "1/1"], ["10", "1", "0/0", "./."]]
    with pytest.raises(ValueError, match="other samples"):
        merging.concatenated([a, make(spark, tmp_path / "c", ["P", "Z"], [])])
