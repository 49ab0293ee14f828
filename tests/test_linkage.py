"""Pairs of sites on different chromosomes against a walk over all of them."""

import random

import pytest

from locusframe.operators import ld
from locusframe.sources import vcf

SAMPLES = [f"S{i}" for i in range(70)]


@pytest.fixture(scope="module")
def genotypes():
    rng = random.Random(5)
    one = lambda: rng.choice(["0", "0", "1", "1", "."])
    return {(f"c{1 + k % 3}", 10 + k): [one() + "|" + one() for _ in SAMPLES] for k in range(40)}


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory, genotypes):
    f = tmp_path_factory.mktemp("vcf") / "a.vcf"
    rows = ["\t".join([c, str(p), ".", "A", "C", ".", ".", ".", "GT", *g]) for (c, p), g in sorted(genotypes.items())]
    f.write_text("\n".join(["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *SAMPLES]), *rows]) + "\n")
    return vcf.read(spark, f"file://{f}")


def r2(x: list, y: list) -> tuple:
    both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    n, sx, sy = len(both), sum(a for a, _ in both), sum(b for _, b in both)
    cov, vx, vy = n * sum(a * b for a, b in both) - sx * sy, n * sum(a * a for a, _ in both) - sx * sx, n * sum(b * b for _, b in both) - sy * sy
    return n, cov * cov / (vx * vy)


def across(values: dict) -> dict:
    return {(*a, *b): r2(values[a], values[b]) for a in values for b in values if a[0] < b[0]}


@pytest.mark.parametrize(("columns", "least"), [(16, 512), (16, 3), (1, 3)])
def test_pairs_across_chromosomes(cohort, genotypes, monkeypatch, columns, least):
    monkeypatch.setattr(ld, "COLUMNS", columns)  # the samples' two words as columns or arrays
    monkeypatch.setattr(ld, "LEAST", least)  # one block or many
    want = across({k: [None if "." in t else t.count("0") for t in g] for k, g in genotypes.items()})
    got = {tuple(r)[:4]: tuple(r)[4:] for r in ld.genotype_r2_across(cohort).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    want = across({k: [None if a == "." else int(a == "0") for t in g for a in t.split("|")] for k, g in genotypes.items()})
    got = {tuple(r)[:4]: tuple(r)[4:6] for r in ld.haplotype_r2_across(cohort, 0.01).collect()}
    kept = {k for k, v in want.items() if v[1] >= 0.01}
    assert got.keys() == kept and 0 < len(kept) < len(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in kept)


def test_pairs_across_chromosomes_are_not_shuffled(cohort):
    for rows in (ld.genotype_r2_across(cohort, 0.2), ld.haplotype_r2_across(cohort, 0.2)):
        above, join, _ = rows._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin [block_a")
        assert join and "Exchange" not in above and "Aggregate" not in above
