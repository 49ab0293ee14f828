"""Spellings of variants, overlaps, lifted features and runs by stretches, against brute force."""

import random

from pyspark.sql import functions as F

from locusframe.operators import compare, representations, sequence, stretches
from locusframe.schema import CALLS, SAMPLES, SITES, Cohort

RNG = random.Random(11)
#: Sequences of few letters, so that insertions and deletions have many spellings.
GENOME = {c: "".join(RNG.choice(letters) for _ in range(n)) for c, letters, n in (("1", "AC", 400), ("2", "ACGT", 300), ("3", "A", 250))}


def chunks(spark, size=30):
    return spark.createDataFrame([(c, i + 1, s[i : i + size]) for c, s in GENOME.items() for i in range(0, len(s), size)], "chrom string, start int, seq string")


def cohort(spark, rows, calls=(), samples=()):
    """rows: (chrom, pos, ref, alts)."""
    sites = [(i, c, p, None, r, list(a), None, [], {}, ".", ["GT"], i) for i, (c, p, r, a) in enumerate(rows)]
    return Cohort(spark.createDataFrame(sites, SITES), spark.createDataFrame(list(calls), CALLS), spark.createDataFrame([(s, i) for i, s in enumerate(samples)], SAMPLES))


def some_variants(rng, n, far=6):
    """Variants at random places; insertions and deletions dominate."""
    out = set()
    for _ in range(n):
        c = rng.choice(list(GENOME))
        s = GENOME[c]
        p = rng.randint(2, len(s) - 20)
        k = rng.choice([1, 1, 2, 3])
        ref = s[p - 1 : p - 1 + k]
        kind = rng.randint(0, 3)
        alt = ref + "".join(rng.choice("AC") for _ in range(rng.randint(1, 3))) if kind == 0 else ref[:1] if kind == 1 and k > 1 else "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 3)))
        if alt != ref:
            out.add((c, p, ref, (alt,)))
    return sorted(out)


def respelled(rng, v):
    """The same change with more of the sequence before and behind it, as far as it goes to the left or right."""
    c, p, ref, (alt,) = v
    s = GENOME[c]
    before, behind = rng.randint(0, min(4, p - 1)), rng.randint(0, 4)
    end = p - 1 + len(ref)
    head, tail = s[p - 1 - before : p - 1], s[end : end + behind]
    p, ref, alt = p - before, head + ref + tail, head + alt + tail
    if rng.random() < 0.5:  # cut what both share at the start, leaving one base, else at the end
        while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0] and ref[1:2] == alt[1:2]:
            p, ref, alt = p + 1, ref[1:], alt[1:]
    return c, p, ref, (alt,)


def made(c, p, length, new):
    s = GENOME[c]
    return s[: p - 1] + new + s[p - 1 + length :]


def test_one_form_for_all_spellings(spark):
    rng = random.Random(2)
    first = some_variants(rng, 120)
    every = [(f"{i}.{k}", *v) for i, f in enumerate(first) for k, v in enumerate([f, *(respelled(rng, f) for _ in range(3))])]
    df = spark.createDataFrame([(k, c, p, len(r), a[0]) for k, c, p, r, a in every], "key string, chrom string, pos int, length int, new string")
    got = {r.key: (r.chrom, r.at, r.gone, r.put) for r in representations.canonical(df, chunks(spark), flank=7).collect()}
    seq = {k: (c, made(c, p, len(r), a[0])) for k, c, p, r, a in every}
    assert len(got) == len(every)
    by_form, by_seq = {}, {}
    for k in got:
        by_form.setdefault(got[k], set()).add(seq[k])
        by_seq.setdefault(seq[k], set()).add(got[k])
        c, at, gone, put = got[k]
        assert GENOME[c][at - 1 : at - 1 + len(gone)] == gone and (c, made(c, at, len(gone), put)) == seq[k]
    assert all(len(x) == 1 for x in by_form.values()) and all(len(x) == 1 for x in by_seq.values())


def plain_comparison(inputs, gap):
    rows = sorted((c, p, i, r, a) for i, v in enumerate(inputs) for c, p, r, a in v)
    groups = []
    for x in rows:
        if groups and groups[-1][-1][0] == x[0] and x[1] - groups[-1][-1][1] <= gap:
            groups[-1].append(x)
        else:
            groups.append([x])
    out = []
    for g in groups:
        seqs, complex_ = {}, set()
        for c, p, i, r, alts in g:
            for a in alts:
                if a[0] in ".<":
                    continue
                seqs.setdefault(i, set()).add(made(c, p, len(r), a))
                if len(a) != len(r):
                    complex_.add(i)
        if len(complex_) > 1:
            files = sorted(complex_)
            out.append((g[0][0], g[0][1], g[-1][1], ",".join(map(str, files)), all(seqs[i] & seqs[j] for i in files for j in files if i < j)))
    return sorted(out)


def test_comparison_by_sequence(spark):
    rng = random.Random(3)
    one = some_variants(rng, 80)
    two = sorted({respelled(rng, v) for v in one if rng.random() < 0.7} | set(some_variants(rng, 20)))
    three = sorted({respelled(rng, v) for v in two if rng.random() < 0.5} | {("2", 9, GENOME["2"][8], ("<DEL>",))})
    for inputs in ([one, two], [one, two, three]):
        for gap in (0, 3, 12):
            got = sorted(tuple(r) for r in representations.compare_sequences([cohort(spark, v) for v in inputs], chunks(spark), gap).collect())
            assert got == plain_comparison(inputs, gap)
            assert {r[-1] for r in got} == {True, False}
    table = representations.sequence_matches([cohort(spark, one), cohort(spark, two)], chunks(spark), 12).collect()
    assert [r.files for r in table] == ["0,1"] and table[0].n_match + table[0].n_mismatch == len(plain_comparison([one, two], 12))


def test_two_spellings_of_a_deletion_match(spark):
    """In AAAA a deleted A has as many spellings as there are As."""
    a, b = cohort(spark, [("3", 10, "AA", ("A",))]), cohort(spark, [("3", 18, "AAA", ("AA",))])
    assert [tuple(r) for r in representations.compare_sequences([a, b], chunks(spark), 10).collect()] == [("3", 10, 18, "0,1", True)]
    assert representations.compare_sequences([a, b], chunks(spark), 3).collect() == []


def test_old_form_to_anchored_and_back(spark):
    s = GENOME["2"]
    at = lambda p, n=1: s[p - 1 : p - 1 + n]
    other = lambda b: "T" if b != "T" else "G"
    old = [
        ("2", 5, at(5), ("IAC",)), ("2", 9, at(9), ("D3",)), ("2", 14, at(14), (other(at(14)),)), ("2", 20, at(20), ("D2", other(at(20)), "IGG", "D4")), ("2", 30, other(at(30)), ("D1",)), ("2", 40, at(40), ()),
    ]
    new = {(r.chrom, r.pos): (r.ref, r.alt) for r in representations.to_anchored(cohort(spark, old).sites, chunks(spark)).collect()}
    assert new["2", 5] == (at(5), [at(5) + "AC"]) and new["2", 9] == (at(9, 4), [at(9)]) and new["2", 14] == (at(14), [other(at(14))])
    assert new["2", 20] == (at(20, 5), [at(20) + at(23, 2), other(at(20)) + at(21, 4), at(20) + "GG" + at(21, 4), at(20)])
    assert new["2", 30] == (other(at(30)), ["D1"]) and new["2", 40] == (at(40), [])
    # what each ALT makes of the sequence is kept
    for _, p, ref, alts in old[:4]:
        want = [made("2", p + 1, 0, a[1:]) if a[0] == "I" else made("2", p + 1, int(a[1:]), "") if a[0] == "D" else made("2", p, 1, a) for a in alts]
        assert [made("2", p, len(new["2", p][0]), a) for a in new["2", p][1]] == want
    # and back: ALTs fall apart by what they are, each at the base before its change
    marked = representations.to_marked(cohort(spark, [("2", p, *new["2", p]) for _, p, _, _ in old if p != 30]).sites)
    back = sorted((r.pos, r.ref, tuple(r.alt)) for r in marked.collect())
    for p, ref, alts in back:
        for a in alts:
            if a[0] in "ID":
                assert ref == at(p)
    again = [(r.pos, r.ref, a) for r in representations.to_anchored(marked, chunks(spark)).collect() for a in r.alt]
    seqs = sorted(made("2", p, len(ref), a) for p, ref, a in again)
    assert seqs == sorted(made("2", p, len(new["2", p][0]), a) for _, p, _, _ in old if p not in (30, 40) for a in new["2", p][1])
    assert (5, at(5), ("IAC",)) in back and (9, at(9), ("D3",)) in back and (40, at(40), ()) in back


def plain_overlaps(one, two):
    out = []
    for chrom in sorted({r[0] for r in one + two}):
        a, b = ([r for r in x if r[0] == chrom] for x in (one, two))
        i = j = 0
        while i < len(a) or j < len(b):
            x, y = a[i] if i < len(a) else None, b[j] if j < len(b) else None
            if x and y and x[1] == y[1]:
                same = x[2] == y[2] or "N" in (x[2], y[2])
                out.append((chrom, x[1], y[1], "B" if same else "O"))
                i, j = i + 1, j + 1
            elif x and y and (x[1] < y[1] < x[1] + len(x[2]) or y[1] < x[1] < y[1] + len(y[2])):
                out.append((chrom, x[1], y[1], "O"))
                i, j = i + 1, j + 1
            elif y is None or x and x[1] < y[1]:
                out.append((chrom, x[1], None, "1"))
                i += 1
            else:
                out.append((chrom, None, y[1], "2"))
                j += 1
    return sorted(out, key=str)


def test_overlapping_sites(spark):
    rng = random.Random(5)
    for dense in (400, 60):
        make = lambda n: sorted({(c, p): (c, p, rng.choice(["A", "N", "AC", "ACG", "ACGTACGT"]), ("T",)) for c, p in ((rng.choice("123"), rng.randint(1, dense)) for _ in range(n))}.values())  # noqa: B023, E731
        one, two = make(90), make(90)
        got = sorted(((r.chrom, r.pos_1, r.pos_2, r.files) for r in compare.overlapping_sites(cohort(spark, one), cohort(spark, two)).collect()), key=str)
        assert got == plain_overlaps(one, two) and {g[3] for g in got} == {"B", "O", "1", "2"}


def test_runs_by_stretches(spark):
    rng = random.Random(6)
    rows = [(c, rng.randint(1, 3000), rng.choice([1, 1, 5, 40, 900]), i) for i, c in enumerate("12" * 100)]
    df = spark.createDataFrame(rows, "chrom string, pos int, n int, id int")
    for width in (50, 1000, 10**6):
        got = {r.id: r.run for r in stretches.runs(df, ["chrom"], F.col("pos") + F.col("n"), ["id"], width).collect()}
        total = {r.id: r.total for r in stretches.running(df, ["chrom"], ["id"], {"total": (F.col("n"), "sum")}, width=width).collect()}
        for chrom in "12":
            reach, run, seen = None, None, 0
            for c, p, n, i in sorted((r for r in rows if r[0] == chrom), key=lambda r: (r[1], r[3])):
                if reach is None or reach <= p:
                    run = p
                reach = max(reach or 0, p + n)
                seen += n
                assert got[i] == run and total[i] == seen


def plain_lift(length, variants, feature):
    """Marks on an array of places, moved as every variant is applied in turn; None if one deletion takes all of it."""
    start, end = feature
    places = list(range(length + 2))  # place -> what stands there, by its old number
    mark = {"s": start, "e": end}
    shift, frozen, hole = 0, 0, {"s": None, "e": None}
    moved = dict(mark)
    for p, ref, alt in variants:
        if p <= frozen:
            continue
        frozen = p + len(ref) - 1
        change = len(alt) - len(ref)
        if change < 0:
            low, high = p + len(alt), p + len(ref) - 1
            for k in "se":
                if low <= mark[k] <= high:
                    hole[k], moved[k] = low, low + shift - (k == "e")
        for k in "se":
            if mark[k] > frozen and hole[k] is None:
                moved[k] += change
        shift += change
    return None if hole["s"] is not None and hole["s"] == hole["e"] else (moved["s"], moved["e"])


def test_lifted_features(spark):
    rng = random.Random(7)
    variants = {}
    for c, p, ref, alt in some_variants(rng, 150):
        variants.setdefault((c, p), (c, p, ref, alt))
    rows = sorted(variants.values())
    samples = ["A", "B"]
    gts = {(i, s): (rng.randint(0, 1), rng.randint(0, 1)) for i in range(len(rows)) for s in samples}
    calls = [(i, s, a, b, 2, True, None, None, [], None, True) for (i, s), (a, b) in gts.items()]
    features = [(c, a, min(a + rng.choice([0, 1, 2, 5, 60]), len(GENOME[c])), f"f{k}") for k, (c, a) in enumerate((c, rng.randint(1, len(GENOME[c]))) for c in list(GENOME) * 25)]
    features += [(c, p + 1, p + len(ref) - 1, f"within{p}") for c, p, ref, alt in rows if len(alt[0]) == 1 < len(ref)]
    table = spark.createDataFrame(features, "chrom string, start int, end int, name string")
    got = {(r.sample_id, r["copy"], r.name): (r.start, r.end) for r in sequence.lifted(cohort(spark, rows, calls, samples), table).collect()}
    gone = 0
    for s in samples:
        for k in (0, 1):
            for c, a, b, name in features:
                own = [(p, ref, alt[0]) for i, (cc, p, ref, alt) in enumerate(rows) if cc == c and gts[i, s][k]]
                want = plain_lift(len(GENOME[c]), own, (a, b))
                gone += want is None
                assert got.get((s, k + 1, name)) == want, (own, a, b)
    assert gone and len(got) == 2 * 2 * len(features) - gone
    # a feature that no variant touches has the same bases on the sequence it is lifted to
    seqs = {}
    for r in sequence.haplotypes(cohort(spark, rows, calls, samples), chunks(spark)).orderBy("start").collect():
        seqs[r.sample_id, r["copy"], r.chrom] = seqs.get((r.sample_id, r["copy"], r.chrom), "") + r.seq
    untouched = 0
    for (s, k, name), (a, b) in got.items():
        c, start, end, _ = next(f for f in features if f[3] == name)
        if not any(cc == c and p <= end and p + max(len(ref), len(alt[0])) > start for cc, p, ref, alt in rows):
            untouched += 1
            assert seqs[s, k, c][a - 1 : b] == GENOME[c][start - 1 : end]
    assert untouched
