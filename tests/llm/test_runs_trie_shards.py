"""Periodic runs, the conversation trie and sharding against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from locusframe.llm import runs, sharding, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11
def plain_runs(w, least):
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q and (s, i + q) not in seen:
                seen.add((s, i + q))
                if i + q - s >= least:
                    out.append((s, i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k, kind = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5, 20]), rng.randint(0, 4)
    w = [rng.randrange(k) for _ in range(n)]
    if kind == 1:  # Fibonacci words have as many runs as few others
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    elif kind == 2:
        w = ([rng.randrange(k) for _ in range(rng.randint(1, 12))] * 120)[:n]
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.randrange(k)
    elif kind == 3:  # stretches that come back, with runs within
        u, v = [rng.randrange(k) for _ in range(rng.randint(1, 25))], [rng.randrange(k) for _ in range(rng.randint(1, 5))]
        w = []
        while len(w) < n:
            w += u + v * rng.randint(0, 6)
    elif kind == 4:
        w = w + w[: rng.randint(0, len(w))]
    return [str(c).encode() for c in w]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(300):
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        assert runs._batch(texts, least) == [plain_runs(w, least) for w in texts]


def test_longest_previous_factors_and_blocks():
    import numpy as np

    rng = random.Random(5)
    for _ in range(50):
        x = np.array([rng.randrange(2) for _ in range(rng.randint(1, 60))] + [9])
        n = len(x)
        longest, source = runs.longest_previous(runs.Names(x))
        for i in range(n):
            best = max((next((k for k in range(n - i) if x[i + k] != x[j + k]), n - i) for j in range(i)), default=0)
            assert longest[i] == best
            assert not best or source[i] < i and (x[source[i] : source[i] + best] == x[i : i + best]).all()
        cuts = runs.blocks(longest)
        assert cuts[0] == 0 and cuts[-1] == n and all(b - a == max(1, longest[a]) for a, b in zip(cuts, cuts[1:]))


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 12)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else None
    gone = {i for s, e, q in found for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(c for i, c in enumerate(w) if i not in gone).encode()).hexdigest())


def test_op11(spark, odd, odd_rows, empty, tmp_path):
    line = "terms of use apply to all of this text "
    rows = [(1000 + i, f"a b c {i} " + line * (i % 4) + "x y\t" * (i % 9) + "end", "en", "a", 1) for i in range(60)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.op11_runs(spark, str(tmp_path)).collect()), key=str)
    texts = [(r[0], r[1]) for r in [*odd_rows, *rows] if len(r[1] or "") < 20000]
    want = sorted((expected_runs(*t) for t in texts), key=str)
    long = [r[0] for r in odd_rows if len(r[1] or "") >= 20000]
    assert [g for g in got if g[0] not in long] == want and len(got) == len(odd_rows) + len(rows)
    assert any(w[1] for w in want if zlib.crc32(str(w[0]).encode()) % 10 == 0) and sum(w[1] for w in want) > 30
    found = runs.find(odd.withColumn("runs", F.lit("clash")))
    assert found.columns[-2:] == ["runs", "collapsed"] and found.count() == len(odd_rows)
    assert runs.find(empty).count() == 0


def test_a_text_of_one_word_is_one_run(spark):
    docs = spark.createDataFrame([(1, "w " * 30000)], "doc_id long, text string")
    r = runs.find(docs).first()
    assert [tuple(x) for x in r.runs] == [(0, 30000, 1)] and r.collapsed == "w"


# 12
def plain_trie(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            conv.setdefault(c, []).append((t, r or "", x or ""))
    conv = {c: [(r, x) for t, r, x in sorted(v, key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))] for c, v in conv.items()}
    built = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = conv.get(c - int(math.fmod(c, 100)), [])[:h] + conv[c][h:]
    node, kids, leaves, saved = {}, {}, {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            node.setdefault(tuple(v[:d]), []).append(c)
    for p in node:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(node, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(node[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in node.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(node[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_op12(spark, tmp_path, monkeypatch):
    """Nulls in any column, ties, repeated rows, negative ids, a base that is absent, a long conversation and windows that hold
    few of its turns, clashing further columns."""
    monkeypatch.setattr(trie, "STRETCH", 3)
    monkeypatch.setattr(trie, "ENDS", 2)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", "é漢", None])) for c in [*range(40), -150, -100, -7, 100, 101, 102, 250] for t in [*[None] * (c % 2), *range(rng.randint(0, 11))]]
    rows += [(None, 1, "u", "z")] + [(7, 3, "u", "x")] * 3 + [(500, t, "u", "a") for t in range(40)] + [(501, t, "u", "a") for t in range(30)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "pos", "depth", "node", "_block")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = trie.op12_trie(spark, str(tmp_path))
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, out.collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    turns, convs = trie.rebuilt(trie.turns_of(spark.createDataFrame([], TURNS)))
    assert trie.trie(turns, convs).count() == 0


def test_conversations_that_are_all_alike(spark):
    rows = [(100 * c, t, "u", f"turn {t}") for c in range(300) for t in range(3)]
    turns, convs = trie.rebuilt(trie.turns_of(spark.createDataFrame(rows, TURNS)))
    assert sorted(map(tuple, trie.trie(turns, convs).collect()), key=str) == plain_trie(rows)


# 13
def test_hypergeometric_is_its_inverse(spark):
    cases = [(20, 7, 5), (100, 30, 60), (50, 50, 10), (50, 0, 10), (10, 10, 10), (1000, 61, 200), (1, 1, 1), (5, 2, 0), (0, 0, 0)]
    rows = [(t, g, n, (j + 0.5) / 100) for t, g, n in cases for j in range(100)]
    got = spark.createDataFrame(rows, "t long, g long, n long, u double").select("t", "g", "n", "u", sharding.hypergeometric(F.col("t"), F.col("g"), F.col("n"), F.col("u")).alias("x")).collect()

    def plain(t, g, n, u):
        low, high = max(0, n - (t - g)), min(n, g)
        mode = max(low, min(high, (n + 1) * (g + 1) // (t + 2)))
        ways, seen = {k: math.comb(g, k) * math.comb(t - g, n - k) for k in range(low, high + 1)}, 0
        for k in [mode, *range(mode + 1, high + 1), *range(mode - 1, low - 1, -1)]:
            seen += ways[k]
            if u * math.comb(t, n) < seen:
                return k

    assert all(r.x == plain(r.t, r.g, r.n, r.u) for r in got)


def test_communication_matrix_has_its_margins_and_spread(spark):
    sizes = spark.range(300).select(F.col("id").cast("int").alias("part"), (F.col("id") * 37 % 5000 + 200).alias("rows"))
    rows = sharding.communication_matrix(sizes, 16).join(sizes, "part").collect()
    n = sum(r.rows for r in rows)
    assert len(rows) == 300 and all(sum(r.counts) == r.rows and min(r.counts) >= 0 for r in rows)
    assert [sum(r.counts[k] for r in rows) for k in range(16)] == [n // 16 + (k < n % 16) for k in range(16)]
    chi = sum((c - r.rows / 16) ** 2 / (r.rows / 16) for r in rows for c in r.counts)  # about 299 * 15 degrees of freedom
    assert abs(chi - 299 * 15) < 6 * math.sqrt(2 * 299 * 15)


def test_op13(spark, odd, odd_rows, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op13_sharding(spark, str(tmp_path)).collect()
    raw = [(r[0], (r[1] or "").encode()) for r in odd_rows]
    assert sorted((str(g.doc_id), g.size, g.text_crc32) for g in got) == sorted((str(i), len(t) + 1, zlib.crc32(t)) for i, t in raw)
    assert all(g.law == "rows" and g.grown_shard is None for g in got)
    counts = [sum(g.shard == k for g in got) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    for k in range(16):
        assert sorted(g.slot for g in got if g.shard == k) == list(range(counts[k]))
    again = sharding.op13_sharding(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = sharding.shuffled(odd.withColumn("slot", F.lit("clash")), 3)
    assert kept.columns == [*odd.columns, "shard", "slot"] and kept.count() == len(odd_rows)
    assert sharding.shuffled(empty).count() == 0


def test_shuffle_is_uniform_and_shards_are_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 7).select("id", F.lit("same text").alias("text"))
    got = sharding.shuffled(rows, 8).collect()
    place = {r.id: (r.shard, r.slot) for r in got}
    assert len(set(place.values())) == 4000
    for key in (lambda i: place[i][0], lambda i: place[i][1] * 8 // 500):  # shards, and eighths of a shard, of each eighth of the input
        seen = [[sum(key(i) == k for i in range(500 * b, 500 * b + 500)) for k in range(8)] for b in range(8)]
        chi = sum((c - 62.5) ** 2 / 62.5 for line in seen for c in line)
        assert chi < 49 + 6 * math.sqrt(2 * 49)
    near = sum(place[i][0] == place[i + 1][0] for i in range(3999))
    assert abs(near - 500) < 6 * math.sqrt(4000 / 8)
    sharding.write_shards(rows, f"{tmp_path}/out", 8)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.groupBy("shard").count().filter("count = 500").count() == 8 and {(r.shard, r.slot) for r in back.collect()} == set(place.values())
