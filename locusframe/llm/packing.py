"""Packing documents into fixed-length sequences: cutting-stock column generation over the histogram of piece lengths.

A document's tokens are cut into pieces of the capacity and one shorter rest.  Rests are grouped into length classes of
``GRAIN`` tokens; the histogram over the classes (at most capacity / GRAIN numbers, whatever the corpus) is the demand of
a cutting-stock linear program, which the driver solves by column generation: a knapsack dynamic program over the dual
prices finds the next pattern.  Rounded patterns become a small table of slots, and the r-th piece of a class (a
distributed rank) finds its sequence by joining that table.

Nulls and odd cases: a null or empty text is the single end token; a null doc_id is kept; repeated rows are packed each
for itself; texts of any length are cut, never shortened; an empty table gives an empty result; further input columns
are ignored.
"""

from __future__ import annotations

import operator
import re
import struct
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import table, written

CAPACITY = 2048
END_ID = 1
#: Tokens a length class spans.
GRAIN = 8
#: Words a Python worker keeps with their ids, and parts of words.
CACHED_WORDS = 1_000_000
#: Hexadecimal digits of the rank key that name a block of a class's order.
BLOCK_DIGITS = 2

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
_CACHE: dict[str, tuple] = {}
#: Code points below U+0180 but for one whose lower case is two: no normalisation changes these, and their classes are known.
#: The four separators that Python takes for white space, but the vocabulary doesn't, are not among them.
PLAIN = re.compile("[^\x1c-\x1f\u0130\u0180-\U0010ffff]*")
#: The vocabulary's own pattern for lower-case text of these, and a separator of texts.
_LETTERS, _DIGITS, BETWEEN = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾", "\x1c"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+|{BETWEEN}")
#: What stands for the separator: no id is that high.
NO_ID = b"\xff" * 4
#: Special tokens begin with this.
SPECIAL = "<|"
#: Characters of texts that are parted at once.
PARTED = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts.  A text of PLAIN characters is lower-cased and parted here as the vocabulary would do it, and the
    ids of each distinct part are kept.

    Of other texts, and of those that may hold a special token, the ids of each distinct word are kept.  No token of the
    vocabulary spans white space and no normalisation step looks across it, so a text's ids are those of its words in a
    row.  Python also splits at the four separators U+001C to U+001F, which the vocabulary doesn't: texts with one of them
    are encoded as a whole."""

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if path not in _CACHE:
            whole, parts = Tokenizer.from_file(path), Tokenizer.from_file(path)
            parts.normalizer, parts.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            _CACHE[path] = whole, parts, {}, {}
        self.path = path
        self.tokenizer, self.part_tokenizer, self.cache, self.parts = _CACHE[path]

    def forget(self) -> None:
        """Give back what the worker keeps."""
        self.cache.clear()
        self.parts.clear()
        _CACHE.pop(self.path, None)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        found = self.part_tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        ends = (4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(parts)))).tolist()
        raw = np.array(found.ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        kept = self.parts
        kept[BETWEEN] = NO_ID
        parts = PARTS.findall(BETWEEN.join(texts).lower())
        ids = list(map(kept.get, parts))
        unknown = list(compress(range(len(ids)), map(operator.is_, ids, repeat(None))))
        new = list({parts[i] for i in unknown})
        for i in range(0, len(new), 20_000):
            kept.update(zip(new[i : i + 20_000], self._of_parts(new[i : i + 20_000])))
        for i in unknown:
            ids[i] = kept[parts[i]]
        return b"".join(ids).split(NO_ID)

    def _other(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache = self.cache
        words = [None if any(c in t for c in self.ODD) else t.split() for t in texts]
        new = list(set().union(*[ws for ws in words if ws]) - cache.keys())
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            cache.update(zip(part, self._whole(part)))
        return [self._whole([t])[0] if ws is None else b"".join(map(cache.__getitem__, ws)) for t, ws in zip(texts, words)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain, other = [], []
        for i, t in enumerate(texts):
            (plain if PLAIN.fullmatch(t) and SPECIAL not in t else other).append(i)
        out = [b""] * len(texts)
        at = 0
        while at < len(plain):
            end, size = at + 1, len(texts[plain[at]])
            while end < len(plain) and size + len(texts[plain[end]]) <= PARTED:
                size += len(texts[plain[end]])
                end += 1
            for i, ids in zip(plain[at:end], self._plain([texts[i] for i in plain[at:end]])):
                out[i] = ids
            at = end
        for i, ids in zip(other, self._other([texts[i] for i in other])):
            out[i] = ids
        return out


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_words: bool = True) -> DataFrame:
    """docs: (doc_id, text).  A row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit) and doc_tokens.
    ``keep_words``: Python workers keep their words for the next task; else they give that memory back after each."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, end = WordTokenizer(path), np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_id, s, min(capacity, n - s), ids[4 * s : 4 * (s + capacity)], n) for s in range(0, n, capacity)]
                a = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.binary()), pa.array(a[4], pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])
        if not keep_words:
            tokenizer.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best value of a pattern within ``room``, and how often it holds each size."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            value = best[c - sizes[:fit]] + prices[:fit]
            i = int(np.argmax(value))
            if value[i] > best[c] + 1e-12:
                best[c], choice[c] = value[i], i
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with pivoting.  The matrices are small, and threaded libraries stall where other work fills the cores."""
    m = len(a)
    both = np.hstack([a, np.eye(m)])
    for k in range(m):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[k]
    return both[:, m:]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000, gap: float = 2e-4) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) pairs that cover ``demand`` pieces of each of the ascending ``sizes`` with sequences of ``room``.

    Column generation on a basis of one pattern a size, until the objective is within ``gap`` (or half a sequence) of the
    bound that the knapsack's value gives; the basis stays feasible, so ``rounds`` only bounds the time.  Patterns are
    rounded down and what is left (less than one use of each) is packed first-fit decreasing.
    """
    m = len(sizes)
    lifted = demand * (1 + 1e-7 * np.random.default_rng(1).random(m))  # no two patterns run out at once
    columns = [np.eye(m)[i] * (room // sizes[i]) for i in range(m)]
    inverse, cost = np.diag([1.0 / (room // s) for s in sizes]), np.ones(m)
    for k in range(rounds):
        if k % 500 == 499:
            inverse = _inverse(np.array(columns).T)
        use, prices = np.einsum("ij,j->i", inverse, lifted), np.einsum("i,ij->j", cost, inverse)
        if prices.min() < -1e-9:  # more of a size than demanded
            i = int(np.argmin(prices))
            enter, price = -np.eye(m)[i], 0.0
        else:
            value, enter = _knapsack(sizes, prices, room)
            price, total = 1.0, float((cost * use).sum())
            if total - total / max(value, 1.0) <= max(0.5, gap * total):
                break
        step = np.einsum("ij,j->i", inverse, enter)
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[out], cost[out] = enter, price
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    use, rest, packed = np.einsum("ij,j->i", _inverse(np.array(columns).T), demand), demand.astype(int).copy(), []
    for x, pattern in zip(use, columns):
        times = int(np.floor(x + 1e-6))
        # the linear program may cover a size more often than demanded
        times = min([times, *(int(-(-rest[i] // p)) for i, p in enumerate(pattern) if p > 0)]) if pattern.max() > 0 else 0
        if times > 0:
            packed.append((times, pattern.astype(int)))
            rest = np.maximum(rest - times * pattern.astype(int), 0)
    while rest.any():
        left, pattern = room, np.zeros(m, int)
        for i in range(m - 1, -1, -1):
            take = min(int(rest[i]), left // int(sizes[i]))
            pattern[i], left = take, left - take * int(sizes[i])
        times = max(1, min(int(rest[i] // p) for i, p in enumerate(pattern) if p))
        packed.append((times, pattern))
        rest -= times * pattern
    return packed


def slots(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces a sequence, first sequence, slot): where each rank of a class goes.

    At most ``room`` classes, about twice as many patterns and a few classes a pattern: the table's size is bounded by
    the capacity, not by the corpus.
    """
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes])
    out, at, sequence = [], np.zeros(len(sizes), int), 0
    for times, pattern in cutting_stock(sizes, demand, room) if len(sizes) else []:
        for slot, i in enumerate(np.flatnonzero(pattern)[::-1]):
            end = min(int(at[i] + times * pattern[i]), int(demand[i]))
            if end > at[i]:
                out.append((int(sizes[i]), int(at[i]), end, int(pattern[i]), sequence, slot))
                at[i] = end
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """pieces: doc_id, start, length and further slim columns.  Adds sequence_id and offset (gapless from 0).

    A rank within a class is the rank within (class, block) plus the counts of the blocks before, so a length that a
    third of all pieces have is ranked by many tasks.
    """
    spark = pieces.sparkSession
    keyed = pieces.withColumns({"_class": F.ceil(F.col("length") / grain).cast("int"), "_key": F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id"), F.lit(-1)), "start"))}).withColumn("_block", F.substring("_key", 1, BLOCK_DIGITS))
    counts = keyed.groupBy("_class", "_block").count()
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("count").alias("n")).collect()}  # at most capacity / grain rows
    plan = spark.createDataFrame(slots(histogram, capacity // grain), "_class int, _lo long, _hi long, _each long, _first long, _slot int")
    before = Window.partitionBy("_class").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_block").orderBy("_key", "doc_id", "start", *[c for c in ("ids_crc32", "doc_tokens") if c in pieces.columns])) - 1)
    ranked = ranked.join(counts, ["_class", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.alias("r").join(F.broadcast(plan.alias("p")), (F.col("r._class") == F.col("p._class")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _lo) div _each").cast("long"))
    order = Window.partitionBy("sequence_id").orderBy("_slot", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", (F.sum("length").over(order) - F.col("length")).cast("long")).select(*pieces.columns, "sequence_id", "offset")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, for pieces that carry their ids through ``pack``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` tokens
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame, keep_words: bool = True) -> DataFrame:
    pieces = token_pieces(docs.select("doc_id", "text"), keep_words=keep_words).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(written(pieces, "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each piece of the documents goes.  The other stages' tasks run in the same Python workers, so
    these keep no words."""
    return packed_documents(docs, keep_words=False)
