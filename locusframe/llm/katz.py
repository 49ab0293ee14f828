"""LM scoring with Katz backoff: Good-Turing discounted bigrams over Good-Turing discounted unigrams.

The event space is the training vocabulary (words and one end of text) plus one class of all unknown words; P1 and every
P( . | history) add up to one over it.  A bigram's history is the word before it, or the start: every word has counts and
a backoff weight of its own, in tables that grow with the corpus.

  P(w | h) = d(c) c(h, w) / (C(h) + 1)    if c(h, w) > 0; one more count is kept for the unseen, so that a history all
                                          of whose bigrams are frequent has something to give
           = a(h) P1(w)                   else; a(h) = (1 - sum of the seen P(w | h)) / (1 - sum of their P1(w))
  P1(w)    = d1(c) c(w) / N               if c(w) > 0; what the discounts leave is the unknown class's

Words are counted (tasks combine, then a shuffle by word).  Then tokens go to shards by word, packed by task: a shard sees
all histories of its words, so it knows c(w), c(h, w) and P1(w), and sends back to each block of documents, sparsely, what
their tokens give; words that would fill half a shard are split by history, and the list of them (fewer than a million)
goes to all tasks.  A word that isn't the end is the history of the next one, so C(h) is c(w) of the history's own shard.
What the shards found of each history is summed by history into the table of backoff weights; unseen bigrams, a row each,
are joined with it.  Discounts enter last, since the sums are linear in them.

Nulls and odd cases: a null or empty text is its end alone; a null doc_id counts as the empty text in the split; without
training documents every word is unknown and scores are 0; repeated rows are counted and scored each; texts are read
whole; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import table, written
from locusframe.llm.langid import remainder
from locusframe.llm.words import mix, word_hashes

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a shard, shards at least, and characters of a block of documents.
SHARD_TOKENS, SHARDS, BLOCK_CHARACTERS = 1_500_000, 24, 8_000_000
#: Words with more training tokens than half a shard's, or than 1 / HOT of all where those would be too many, are split
#: by history: fewer than HOT.
HOT = 1_000_000
END, START = np.uint64(0x5EED_0000_0000_0001), np.uint64(0x5EED_0000_0000_0002)


def discounts(of: list[float]) -> list[float]:
    """d(1) .. d(5) by Katz from the counts of counts n(1) .. n(6).  A count for which they leave a discount outside
    (0, 1), as copies in the corpus may do, loses one half instead."""
    k, n = DISCOUNTED, [0.0, *of]
    spare = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare) if n[r] and spare < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Unigrams:
    """P1 and the base model, from the counts of the training tokens."""

    def __init__(self, tokens: int, words: int, of: list[float]):
        self.tokens, self.words, self.d = max(tokens, 1), words, np.array([0.0, *discounts(of)])
        taken = sum(n * r * (1 - self.d[r]) for r, n in enumerate(of[:DISCOUNTED], 1))
        # a vocabulary of frequent words alone leaves nothing: one more token, then, for the unknown ones
        self.total = self.tokens + (taken <= 0)
        self.unknown = max(taken, float(taken <= 0)) / self.total if tokens else 1.0

    def p1(self, c: np.ndarray) -> np.ndarray:
        seen = np.where(c <= DISCOUNTED, self.d[np.minimum(c, DISCOUNTED)], 1.0) * c / self.total
        return np.where(c > 0, seen, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        tokens = self.tokens if self.words else 0
        return np.log10((c + 0.1) / (tokens + 0.1 * (self.words + 1)))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before it, document) of every token of the texts."""
    words, n = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(words) + len(n), END)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words
    before = np.concatenate([[START], out[:-1]]) if len(out) else out
    before[(ends + 1)[:-1]] = START
    return out, before, np.repeat(np.arange(len(n)), n + 1).astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray]]:
    """(doc_ids, texts, held_out) in blocks of BLOCK_CHARACTERS and at most 2^15 documents."""
    ids, texts, held, size = [], [], [], 0
    for batch in batches:
        for i, t, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ids.append(i)
            texts.append(t)
            held.append(h)
            size += len(t or "")
            if size > BLOCK_CHARACTERS or len(ids) == 2**15:
                yield ids, texts, np.array(held, bool)
                ids, texts, held, size = [], [], [], 0
    if ids:
        yield ids, texts, np.array(held, bool)


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, held_out).  (word, count) over the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, held in _blocks(batches):
            words, n = np.unique(tokens_of([t for t, out in zip(texts, held) if not out])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "count"])

    return docs.mapInArrow(count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _dump(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *[a.tobytes() for a in arrays]])


def _load(raw: bytes, *types) -> list[np.ndarray]:
    n, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for size, t in zip(n.tolist(), types):
        out.append(np.frombuffer(raw, t, size, at))
        at += size * np.dtype(t).itemsize
    return out


PACKED = "shard int, block long, own boolean, packed binary"
TOKENS = (np.uint64, np.uint32, np.uint64, np.uint16, np.uint32, np.uint8, np.uint32, np.uint16)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def pack_tokens(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """A row a block and shard: words, histories a word, distinct histories and each one's place among them in two bytes
    or four, documents a (word, history) in one byte or four, documents (the high bit: held out); sorted.  One more row a
    block has its documents: doc_id, held_out, tokens."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for no, (ids, texts, held) in enumerate(_blocks(batches)):
            w, h, d = tokens_of(texts)
            own = _dump(np.array([i is None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64), held.astype(np.uint8), np.bincount(d, minlength=len(ids)).astype(np.int64))
            rows = [((task + no) % shards, task + no, True, own)]
            shard = (w % np.uint64(shards)).astype(np.int32)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w
                shard = np.where(is_hot, (mix(w ^ mix(h)) % np.uint64(shards)).astype(np.int32), shard)
            order = np.lexsort((d, h, w, shard))
            w, h, d, shard = w[order], h[order], d[order], shard[order]
            d = d.astype(np.uint16) | (held[d].astype(np.uint16) << np.uint16(15))
            bounds = np.searchsorted(shard, np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                at = slice(bounds[k], bounds[k + 1])
                first = np.flatnonzero(_runs(w[at], h[at]))
                of_h = np.diff(np.append(first, at.stop - at.start))
                ws = w[at][first]
                first_w = np.flatnonzero(_runs(ws))
                hs, place = np.unique(h[at][first], return_inverse=True)
                small, few = len(hs) < 2**16, of_h.max() < 256
                none = np.zeros(0, int)
                packed = _dump(
                    ws[first_w], np.diff(np.append(first_w, len(ws))).astype(np.uint32), hs, (place if small else none).astype(np.uint16), (none if small else place).astype(np.uint32),
                    (of_h if few else none).astype(np.uint8), (none if few else of_h).astype(np.uint32), d[at],
                )
                rows.append((k, task + no, False, packed))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], ["shard", "block", "own", "packed"])

    return docs.mapInArrow(pack, PACKED)


COUNTED = "kind string, key long, block long, doc int, a1 int, a2 int, a3 int, a4 int, a5 int, a6 int, p double, packed binary"
COLUMNS = {"key": pa.int64(), "block": pa.int64(), "doc": pa.int32(), **{f"a{r}": pa.int32() for r in range(1, 7)}, "p": pa.float64(), "packed": pa.binary()}
PARTS = (np.int32, np.float64, np.float64, np.int32, *[np.uint32] * DISCOUNTED)
#: Rows of a batch that goes back to Spark.
ROWS_AT_ONCE = 50_000


def _counted(kind: str, n: int, **columns) -> list[pa.RecordBatch]:
    """``n`` rows of COUNTED; the columns not given are null."""
    arrays = [pa.array([kind], pa.string()).take(pa.array(np.zeros(n, np.int32))), *[pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in COLUMNS.items()]]
    whole = pa.RecordBatch.from_arrays(arrays, ["kind", *COLUMNS])
    return [whole.slice(at, ROWS_AT_ONCE) for at in range(0, n, ROWS_AT_ONCE)]


def count_shards(packed: DataFrame, unigrams: Unigrams, hot: dict[int, int]) -> DataFrame:
    """What the shards find: kind 'of' (numbers of bigrams counted 1 to 6 times), 'history' (key: history; a1..a5: its
    bigrams by count; p: the sum of their P1), 'lost' (a row an unseen bigram; key: history; block and doc: where it is)
    and 'documents' (packed, of a block's documents with tokens here: sums of log10 c or log10 P1 less log10 (c + 1) of the
    words as histories, of the base model, of known tokens, of seen tokens by count 1..5)."""
    none = pa.schema([("kind", pa.string()), *COLUMNS.items()])

    def count(table_: pa.Table) -> pa.Table:
        rows: list[pa.RecordBatch] = []
        blocks, ws, hs, ds = [], [], [], []
        for block, own, raw in zip(table_.column("block").to_pylist(), table_.column("own").to_pylist(), table_.column("packed")):
            if own:
                rows += _counted("own", 1, block=[block], packed=[raw.as_py()])
                continue
            w, of_w, h, place2, place4, of_h1, of_h4, d = _load(raw.as_py(), *TOKENS)
            of_h = of_h1 if len(of_h1) else of_h4
            ws.append(np.repeat(np.repeat(w, of_w), of_h))
            hs.append(np.repeat(h[place2 if len(place2) else place4], of_h))
            ds.append(d.astype(np.int64) + (len(blocks) << 16))
            blocks.append(block)
        if not blocks:
            return pa.Table.from_batches(rows, none)
        # arrays as long as the shard's tokens are dropped as soon as they are used
        w, ws = np.concatenate(ws), None
        h, hs = np.concatenate(hs), None
        d, ds = np.concatenate(ds), None
        order = np.lexsort((h, w))
        w = w[order]
        h = h[order]
        d = d[order]
        order = None
        out, d = (d >> 15) & 1 == 1, (d >> 16 << 15) | (d & 0x7FFF)
        new_w, new = _runs(w), _runs(w, h)
        word, pair = np.cumsum(new_w, dtype=np.int32) - 1, np.cumsum(new, dtype=np.int32) - 1
        kinds = w[new_w]
        w = new_w = None
        c_word = np.bincount(word, ~out).astype(np.int64)
        for i, x in enumerate(kinds.tolist() if hot else ()):
            if (c := hot.get(x)) is not None:
                c_word[i] = c
        c_pair = np.bincount(pair, ~out).astype(np.int64)
        p1 = unigrams.p1(c_word)
        at_pair = np.flatnonzero(new)
        rows += _counted("of", 1, **{f"a{r}": [int((c_pair == r).sum())] for r in range(1, 7)})
        kept = c_pair > 0
        c_kept = c_pair[kept]
        histories, index = np.unique(h[at_pair][kept], return_inverse=True)
        by = {f"a{r}": np.bincount(index[c_kept == r], minlength=len(histories)).astype(np.int32) for r in range(1, 6)}
        rows += _counted("history", len(histories), key=histories.view(np.int64), p=np.bincount(index, p1[word[at_pair]][kept], len(histories)), **by)
        new = histories = index = by = at_pair = kept = c_kept = out = None
        c, pair = c_pair.astype(np.int32)[pair], None
        lost = np.flatnonzero(c == 0)
        rows += _counted("lost", len(lost), key=h[lost].view(np.int64), block=np.array(blocks)[d[lost] >> 15], doc=(d[lost] & 0x7FFF).astype(np.int32))
        h = lost = None
        docs, index = np.unique(d, return_inverse=True)
        d, n = None, len(docs)
        value = np.log10(np.maximum(c, 1), where=c > DISCOUNTED, out=np.zeros(len(c)))
        np.copyto(value, np.log10(p1)[word], where=c == 0)
        value -= np.where(kinds == END, 0.0, np.log10(c_word + 1.0))[word]
        sums = [np.bincount(index, value, n)]
        value = None
        sums += [np.bincount(index, unigrams.base(c_word)[word], n), np.bincount(index, (c_word > 0)[word], n).astype(np.int32), *[np.bincount(index, c == r, n).astype(np.uint32) for r in range(1, 6)]]
        bounds = np.searchsorted(docs, np.arange(len(blocks) + 1) << 15)
        for i, block in enumerate(blocks):
            a, b = bounds[i], bounds[i + 1]
            if a < b:
                rows += _counted("documents", 1, block=[block], packed=[_dump((docs[a:b] & 0x7FFF).astype(np.int32), *[s[a:b] for s in sums])])
        return pa.Table.from_batches(rows, none)

    return packed.groupBy("shard").applyInArrow(count, COUNTED)


def backoff_weights(found: DataFrame, d: list[float]) -> DataFrame:
    """(history, backoff) of every history with bigrams: log10 of (C(h) + 1) a(h)."""
    left = sum(F.col(f"a{r}") * (r * (1 - d[r - 1])) for r in range(1, DISCOUNTED + 1))
    of = found.filter("kind = 'history'").groupBy(F.col("key").alias("history")).agg(F.sum(left).alias("left"), F.sum("p").alias("p"))
    return of.select("history", F.log10((1 + F.col("left")) / (1 - F.col("p"))).alias("backoff"))


SCORED = "block long, doc int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def finish(documents: DataFrame, d: list[float], starts: int) -> DataFrame:
    """documents: (block, own, packed), the documents of a block and what the shards found.  starts: C of the start.  The
    scores lack the backoff weights of unseen bigrams."""
    log_d = np.log10(np.array(d) * np.arange(1, DISCOUNTED + 1))

    def add(table_: pa.Table) -> pa.Table:
        own = next(x.as_py() for x, mine in zip(table_.column("packed"), table_.column("own").to_pylist()) if mine)
        none, ids, held, n_tokens = _load(own, np.uint8, np.int64, np.uint8, np.int64)
        score, base, known = np.full(len(ids), -np.log10(starts + 1)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for x, mine in zip(table_.column("packed"), table_.column("own").to_pylist()):
            if not mine:
                at, value, b, k, *by = _load(x.as_py(), *PARTS)
                score[at] += value + sum(n * l for n, l in zip(by, log_d))
                base[at] += b
                known[at] += k
        return pa.Table.from_arrays(
            [table_.column("block").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(ids), np.int32))), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, mask=none == 1), pa.array(held == 1), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score)],
            ["block", "doc", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return documents.groupBy("block").applyInArrow(add, SCORED)


def score(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, held_out).  The model is trained on the rows not held out; all are scored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    words = written(word_counts(docs), "word-counts")
    ends = F.sum(F.when(F.col("word") == int(END), F.col("count")))  # a start for every end
    tokens, starts, kinds, *of = words.agg(F.sum("count"), ends, F.count("*"), *[F.sum((F.col("count") == r).cast("long")) for r in range(1, 7)]).first()
    tokens, of = tokens or 0, [float(n or 0) for n in of]
    unigrams = Unigrams(tokens, kinds, of)
    hot = {int(np.int64(r["word"]).view(np.uint64)): r["count"] for r in words.filter(F.col("count") > max(SHARD_TOKENS / 2, tokens / HOT)).collect()}  # fewer than HOT
    shards = max(SHARDS, -(-tokens // SHARD_TOKENS))
    found = written(count_shards(pack_tokens(docs, shards, np.array(sorted(hot), np.uint64)), unigrams, hot), "shards")
    bigrams = found.filter("kind = 'of'").agg(*[F.sum(f"a{r}") for r in range(1, 7)]).first()
    d = discounts([float(n or 0) for n in bigrams])
    backoff = written(backoff_weights(found, d), "backoff-weights")
    lost = found.filter("kind = 'lost'").select(F.col("key").alias("history"), "block", "doc").join(backoff, "history").groupBy("block", "doc").agg(F.sum("backoff").alias("backoff"))
    documents = found.filter("kind in ('documents', 'own')").select("block", (F.col("kind") == "own").alias("own"), "packed")
    scored = finish(documents, d, starts or 0).join(lost, ["block", "doc"], "left")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", (F.col("score") + F.coalesce("backoff", F.lit(0.0))).alias("score"), F.lit(int(tokens)).cast("long").alias("train_tokens"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (remainder(F.col("doc_id"), 10) == 0).alias("held_out")))
