"""A user's own rules, and folders of records by combination of inputs."""

import os

from pyspark.sql import functions as F

from locusframe.operators import records, rules, sets
from locusframe.operators.rules import Rule
from locusframe.sources import vcf

HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]


def make(spark, path, rows, head=HEAD):
    path.write_text("\n".join([*head, *("\t".join(r) for r in rows)]) + "\n")
    return vcf.read(spark, str(path))


def test_example_rules(spark, tmp_path):
    c = make(spark, tmp_path / "a.vcf", [
        ["1", "1", "rs", "A", "C", ".", "PASS", "AF1=0.001;DP=9;SILLY=x;XY=42", "GT:PL:DP", "0/1:5,9,9:9", "0/0:1,2,3:1"],
        ["1", "2", ".", "A", "AC", ".", "q", "INDEL;DP4=1,1,100,100;DP=9;SILLY=x", "GT:PL", "0/1:9,0,9", "0/1:1,2,3"],
        ["1", "3", "rs", "A", "C", ".", "FewAlts", "AF1=0.5;DP4=100,100,1,1;DP=5;SILLY=x;PV4=1,0.5,.,2e-3;XY=41", "GT:PL:DP", "0|1:9,0,9:1", "1:1,2,3:0"],
        ["1", "4", ".", "A", ".", ".", ".", "DP4=10,10,5,5;XY=42", "GT:DP", "0/0:1", "0/0:5"],
        ["1", "5", ".", "A", "C", ".", ".", "DP4=10,10,5,5;XY=42", "DP", "7", "8"],
    ])
    got = rules.apply_rules(c, rules.EXAMPLES)
    s = {r.pos: (r["filter"], r.info) for r in got.sites.collect()}
    assert s[1] == (["MinAF"], {"AF1": "0.001", "DP": "9", "XY": "42", "SINGLETON": "1"})
    assert s[2] == (["Indel", "XY", "q"], {"INDEL": "1", "DP4": "1,1,100,100", "DP": "9", "SILLY": "x"})
    assert s[3] == (["NoHets", "XY"], {"AF1": "0.5", "DP4": "100,100,1,1", "DP": "5", "SILLY": "x", "PV4": "1,0.5,.,2e-3", "PV0": "1", "PV1": "0.5", "PV2": ".", "PV3": "2e-3", "XY": "41"})
    assert s[4] == (["PASS"], {"DP4": "10,10,5,5", "XY": "42"}) and s[5] == (["FewAlts"], {"DP4": "10,10,5,5", "XY": "42"})
    at = {r.site_id: r.pos for r in c.sites.collect()}
    calls = {(at[r.site_id], r.sample_id): (r.a1, r.a2, r.ploidy) for r in got.calls.collect()}
    assert calls[1, "A"] == (0, 1, 2) and calls[1, "B"] == (None, None, 2) and calls[3, "A"] == (None, None, 2) and calls[3, "B"] == (None, None, 1) and calls[2, "B"] == (0, 1, 2) and calls[4, "A"] == (None, None, 2)


def test_no_rules_change_nothing_and_edits_follow_each_other(spark, tmp_path):
    c = make(spark, tmp_path / "a.vcf", [["1", "1", ".", "A", "C", ".", ".", "DP=3", "GT", "0/1", "0/0"]])
    assert rules.apply_rules(c, []).sites.first()["filter"] == []
    got = rules.apply_rules(c, [Rule("a", "INFO/DP", info={"X": lambda v: v}), Rule("b", "INFO/DP", info={"X": lambda v: F.concat(v, F.lit("!")), "Y": lambda v: F.lit("1")}), Rule("c", "INFO/NO", fails=lambda v: F.lit(True)), Rule("d", "INFO/X", fails=lambda v: F.lit(True))])
    assert got.sites.first().info == {"DP": "3", "X": "3!", "Y": "1"} and got.sites.first()["filter"] == ["PASS"]


def test_local_filters_by_name(spark, tmp_path):
    c = make(spark, tmp_path / "a.vcf", [["1", "1", ".", "A", "C", "5", ".", "HWE=0.01;G3=0.1,0.8,0.1", "GT", "0/1", "0/0"], ["1", "2", ".", "N", "C", "50", ".", "HWE=0.01;G3=0.5,0,0.5;DP=3", "GT", "0/1", "0/0"], ["1", "3", ".", "A", "C", "50", ".", "HWE=0.9;G3=0.1,0.8,0.1;DP=30", "GT", "0/1", "0/0"]])
    got = records.named_filters(c.sites, records.local_rules(HWE_G3=0.05, Qual=10, RefN=1, MinDP=5, MaxDP=20))
    assert [r["filter"] for r in got.orderBy("pos").collect()] == [["HWE_G3", "Qual"], ["MinDP", "RefN"], ["MaxDP"]]


def test_a_folder_a_combination(spark, tmp_path):
    row = lambda p, alt="C": ["1", str(p), f"r{p}", "A", alt, ".", ".", f"DP={p}", "GT", "0/1", "0/0"]
    other = [h.replace("\tA\tB", "\tC\tD") for h in HEAD]
    inputs = [make(spark, tmp_path / "a", [row(p) for p in (1, 2, 5, 9)]), make(spark, tmp_path / "b", [row(p, "G") for p in (2, 3, 5, 30)], other), make(spark, tmp_path / "c", [row(p) for p in (5, 10, 100)])]
    out = str(tmp_path / "out")
    sets.write_combinations(inputs, out)
    folders = {d.removeprefix("files="): d for d in os.listdir(out) if d.startswith("files=")}
    assert set(folders) == {"0", "1", "2", "0_1", "0_1_2"}
    back = {k: vcf.read(spark, f"{out}/{d}") for k, d in folders.items()}
    at = {k: sorted(r.pos for r in c.sites.collect()) for k, c in back.items()}
    assert at == {"0": [1, 9], "1": [3, 30], "2": [10, 100], "0_1": [2], "0_1_2": [5]}
    assert {k: [r.sample_id for r in c.samples.orderBy("sample_idx").collect()] for k, c in back.items()} == {"0": ["A", "B"], "1": ["C", "D"], "2": ["A", "B"], "0_1": ["A", "B"], "0_1_2": ["A", "B"]}
    assert back["0_1"].sites.first().alt == ["C"] and back["1"].sites.filter("pos = 3").first().info == {"DP": "3"}
    files = {r.files: r.n for r in sets.combinations(inputs, gap=1).groupBy("files").agg(F.count("*").alias("n")).collect()}
    assert files == {"0_1": 2, "0_1_2": 1, "0_2": 1, "1": 1, "2": 1}  # 1, 2 and 3 are one cluster, and 9 and 10
