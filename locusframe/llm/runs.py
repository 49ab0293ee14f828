"""Periodic runs of words in whole texts, and texts without the repeats they hold.

A run is a maximal stretch of consecutive words with smallest period q and a length of at least 2 q.  All of a text are
found in the way of Main, and Kolpakov and Kucherov:

1. The suffix array of the words, by prefix doubling.  The names that each doubling gives to blocks of 2^k words are kept,
   so that the longest common extension of any two places, forwards or backwards, is a walk down these names.
2. The longest previous factor of each place, from its neighbours in the suffix array that stand before it in the text,
   and their longest common prefixes.
3. Lempel-Ziv blocks, cut off the longest previous factors.
4. Runs that touch a block's border.  Of the border's two neighbours one bounds the period: if the last block that a run
   reaches starts at least q words behind the run's start, the run covers q words left of that border and q is no more than
   both blocks together, else it covers q words right of it and q is no more than that block.  So each border and period is
   tried once to the left and once to the right, by extensions both ways; the sum of all trials is linear in the text.
5. Runs strictly within a block, copied from the block's earlier occurrence, where they have been found by then: starts
   are filled in from left to right, in a bucket a start.

Texts of a batch are put behind each other, each with words of its own and a closing word, so no run spans two of them.
Every text is handled within one task, by arrays as long as the text; nothing is shuffled.

Nulls and odd cases: a null text or one without words has no runs, its collapsed text is empty; a null doc_id is kept (the
query repeats no words in its document); repeated rows are handled each by itself; texts are read whole; an empty table
gives an empty result; further columns are kept by ``find`` under any name but ``runs`` and ``collapsed``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.llm.common import WORD, table

#: Words of a run at least.
MIN_LENGTH = 12
#: Words that are handled at once; a longer text is handled alone.
AT_ONCE = 100_000


class Names:
    """Suffix array of a sequence whose largest value occurs at its end, and names of its blocks of 2^k values."""

    def __init__(self, x: np.ndarray):
        n = self.n = len(x)
        order = np.argsort(x, kind="stable")
        sorted_x = x[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))
        size = np.diff(np.append(first, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, size)
        self.levels = [rank.astype(np.int32)]
        at = order[np.repeat(size > 1, size)]  # places whose block is not alone
        step = 1
        while len(at):
            key = rank[at] * n + rank[at + step]  # a block that holds a closing value is alone, so at + step is inside
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            old, k = rank[at], np.arange(len(at))
            group = np.concatenate([[True], old[1:] != old[:-1]])
            new = np.concatenate([[True], key[1:] != key[:-1]])
            name = old + np.maximum.accumulate(np.where(new, k, 0)) - np.maximum.accumulate(np.where(group, k, 0))
            rank = rank.copy()
            rank[at] = name
            self.levels.append(rank.astype(np.int32))
            alone = new & np.append(new[1:], True)
            at, step = at[~alone], step * 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        self.rank = rank

    def _extension(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        length = np.zeros(len(i), np.int64)
        same, tops = np.arange(len(i)), []
        for k, names in enumerate(self.levels):  # up, as long as whole blocks agree
            a, b = i[same], j[same]
            if back:
                inside = (a >= (1 << k) - 1) & (b >= (1 << k) - 1)
                same, a, b = same[inside], a[inside] - (1 << k) + 1, b[inside] - (1 << k) + 1
            same = same[names[a] == names[b]]
            if not len(same):
                break
            tops.append(same)
        for k in range(len(tops) - 1, -1, -1):  # down: those that agreed in a block of 2^k or more may go on
            at = tops[k]
            names, d = self.levels[k], length[at]
            if back:
                a, b = i[at] - d - (1 << k) + 1, j[at] - d - (1 << k) + 1
                inside = (a >= 0) & (b >= 0)
                at, a, b = at[inside], a[inside], b[inside]
            else:
                a, b = i[at] + d, j[at] + d
            length[at[names[a] == names[b]]] += 1 << k
        return length

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Values that agree from places i and j on, for i != j."""
        return self._extension(i, j, back=False)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Values that agree up to and with places i and j, for i != j; places before the start agree with nothing."""
        return self._extension(i, j, back=True)


def _nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each index the nearest one in direction ``step`` with a smaller value, or -1: pointers jump over pointers."""
    n = len(values)
    low = np.append(values, -1)
    to = np.arange(n + 1) + step
    to[(to < 0) | (to > n)] = n
    to[n] = n
    at = np.flatnonzero(low[to[:n]] > values)
    while len(at):
        to[at] = to[to[at]]
        at = at[low[to[at]] > values[at]]
    return np.where(to[:n] == n, -1, to[:n])


def longest_previous(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor of each place, a place before it where the factor occurs too)."""
    n, sa = names.n, names.suffixes
    best, source = np.zeros(n, np.int64), np.full(n, -1)
    for step in (-1, 1):
        near = _nearest_smaller(sa, step)
        have = np.flatnonzero(near >= 0)
        i, j = sa[have], sa[near[have]]
        some = names.levels[0][i] == names.levels[0][j]
        i, j = i[some], j[some]
        length = names.forward(i, j)
        better = length > best[i]
        best[i[better]], source[i[better]] = length[better], j[better]
    return best, source


def blocks(longest: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end of the last one."""
    out, at, step, n = [], 0, np.maximum(longest, 1).tolist(), len(longest)
    while at < n:
        out.append(at)
        at += step[at]
    return np.array([*out, n])


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each, number from 1 within the row) of rows that have ``counts`` entries."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def _touching(x: np.ndarray, names: Names, cuts: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of runs that touch a border of blocks; end is exclusive."""
    n, found = len(x), []
    border, length = cuts[1:], np.diff(cuts)
    after = np.append(length[1:], 0)
    padded = np.append(x, -1)
    for left in (True, False):
        row, q = _ragged(np.minimum(length + after, border) if left else after)
        # place i of a stretch where i and i + q agree: behind it forwards, before it backwards
        i = border[row] - q if left else border[row]
        ok = (i + q <= n) & (i >= 0)
        i, q = i[ok], q[ok]
        ahead = (i + q < n) & (padded[i] == padded[np.minimum(i + q, n)])
        behind = (i > 0) & (padded[i - 1] == padded[i + q - 1])
        some = ahead | behind
        i, q, ahead, behind = i[some], q[some], ahead[some], behind[some]
        right, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        right[ahead] = names.forward(i[ahead], (i + q)[ahead])
        back[behind] = names.backward(i[behind] - 1, (i + q)[behind] - 1)
        whole = (right + back >= q) & (right + back + q >= least)
        i, q, right, back = i[whole], q[whole], right[whole], back[whole]
        found.append(np.stack([i - back, i + right + q, q], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # a stretch has its smallest period first
    return rows[keep]


def runs_of(x: np.ndarray, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of ``least`` values or more, by start, then period."""
    if len(x) < 2:
        return []
    names = Names(x)
    longest, source = longest_previous(names)
    cuts = blocks(longest)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, q in _touching(x, names, cuts, least).tolist():
        buckets.setdefault(s, []).append((e, q))
    starts = sorted(buckets)
    if starts:
        long = np.flatnonzero(np.diff(cuts) >= least + 2)
        for b, e in zip(cuts[long].tolist(), cuts[long + 1].tolist()):
            shift = b - int(source[b])
            at = bisect_left(starts, b - shift + 1)
            while at < len(starts) and starts[at] + shift <= e - 1 - least:
                s = starts[at] + shift
                copied = [(end + shift, q) for end, q in buckets[starts[at]] if end + shift < e]
                if copied:
                    if s not in buckets:
                        insort(starts, s)  # behind ``at``: s is larger
                    own = buckets.setdefault(s, [])
                    own.extend(r for r in copied if r not in own)
                at += 1
    return [(s, e, q) for s in starts for e, q in sorted(buckets[s], key=lambda r: r[1])]


def _batch(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, places counted from its start."""
    ids, ends, n = [], [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        ids.append(np.array([own.setdefault(w, len(own)) for w in words], np.int64) + n)
        n += len(own) + 1
        ids.append(np.array([n - 1]))  # closes the text, occurs once
        ends.append(len(words) + 1)
    ends = np.cumsum(ends).tolist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    k = 0
    for s, e, q in runs_of(np.concatenate(ids), least) if ids else []:
        while s >= ends[k]:
            k += 1
        base = ends[k - 1] if k else 0
        out[k].append((s - base, e - base, q))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        drop[s + q] += 1
        drop[e] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist())


def find(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """Adds to ``docs``, which has a text: runs, array<struct<start, length, period>> by start, then period, numbers of
    words from 0; and collapsed, the text's words joined by a space, without those that any run holds after its first
    period.  A run has ``least`` words or more, and at least twice its period."""
    columns = [c for c in docs.columns if c not in ("runs", "collapsed")]
    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kept = docs.select(*columns)
    schema = T.StructType(list(kept.schema)).add("runs", T.ArrayType(run)).add("collapsed", "string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = whole.column(whole.schema.get_field_index("text"))
            at = 0
            while at < whole.num_rows:
                texts, size, first = [], 0, at
                while at < whole.num_rows:
                    words = (text[at].as_py() or "").encode().split()  # splits at the six ASCII spaces
                    if texts and size + len(words) > AT_ONCE:
                        break
                    texts.append(words)
                    size, at = size + len(words) + 1, at + 1
                runs = _batch(texts, least)
                new = [
                    pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in r] for r in runs], arrow),
                    pa.array([_collapsed(w, r).decode() for w, r in zip(texts, runs)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(whole.column(i).slice(first, at - first) for i in range(len(columns))), *new], [*columns, "runs", "collapsed"])

    return kept.mapInArrow(apply, schema)


def repeated(doc_id: Column, text: Column) -> Column:
    """``text``, or in one of ten documents, drawn by the checksum h of doc_id, its words with all from a on replaced by
    word a + (i - a) % p: a = g % n, p = 1 + (n - a) div (3 + g % 8), g = h div 10, of n words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def turned(v: Column) -> Column:
        n = F.size(v["words"]).cast("long")
        a = v["g"] % n
        return F.transform(F.array(F.struct(v["words"].alias("words"), n.alias("n"), a.alias("a"), (F.floor((n - a) / (v["g"] % 8 + 3)) + 1).cast("long").alias("p"))), lambda u: F.array_join(
            F.transform(u["words"], lambda w, i: F.when(i < u["a"], w).otherwise(F.element_at(u["words"], (u["a"] + (i - u["a"]) % u["p"] + 1).cast("int")))), " "))[0]

    g = F.floor(h / 10).cast("long")
    changed = F.transform(F.array(F.struct(words.alias("words"), g.alias("g"))), turned)[0]
    return F.when((h % 10 == 0) & text.rlike(WORD), changed).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text"))
    found = find(docs).drop("text")
    best = F.element_at(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(
        a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
