"""Quality classifier: an interpolated modified Kneser-Ney model of n-grams of code points, trained on trusted text.

Characters are taken as they are, in any script, so the number of n-grams grows with the corpus.  Tasks count them by
blocks of trusted texts, the counts meet by n-gram in an aggregate, and continuation counts, discounts, probabilities and
backoff weights of all orders are tables keyed by n-gram; the driver gets eight counts an order.  The documents to be
scored are packed into blocks; the distinct n-grams of a block are joined with the model by n-gram, those that it hasn't
with the tables of lower orders in turn, and their probabilities go back to the block, where each document gets its
perplexity.  A document is kept if its perplexity is within the quantile, and a margin beyond it, of trusted documents of
its language that the model has not seen: a share of them, drawn by a hash of doc_id, is held out for the thresholds.

Nulls and odd cases: a null or empty text has no perplexity and is not kept; a null lang is a language of its own; a
language without held-out documents takes the threshold over all held-out ones, trusted documents so few that none is held
out give thresholds themselves, and without any all texts are kept; a null
doc_id is never trusted; repeated rows are scored each; labels repeated for a doc_id count as trusted if any is; texts
are scored whole; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import bloom_filters, table, written

ORDER = 4
#: Characters of a block, unless a single text is longer.
BLOCK = 13_000_000
#: Share of a language's trusted documents that its threshold lets pass.
QUANTILE = 0.995
#: One of so many trusted documents is held out, and the factor by which a perplexity may exceed theirs: prose of the test
#: tables is at 4 to 12, seen or not, scrambled text at 50 and more.
HELD_OUT, MARGIN = 4, 1.25
#: Steps of log10 perplexity in which quantiles are taken.
STEP = 0.001
#: Languages whose thresholds are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


class Coded:
    """The n-grams of some texts, behind ORDER - 1 line ends each."""

    def __init__(self, texts: list[str]):
        start = "\n" * (ORDER - 1)
        codes = np.frombuffer(start.join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = np.array([len(t) for t in texts], np.int64)
        #: where each text's n-grams begin
        self.begin = np.cumsum(self.n + ORDER - 1) - self.n - ORDER + 1
        symbols = pa.array(codes).dictionary_encode()
        alphabet, symbol = symbols.dictionary.to_numpy(), symbols.indices.to_numpy()
        #: the distinct n-grams' code points, and the n-gram at each place
        self.points, self.at = alphabet.reshape(-1, 1), symbol
        for n in range(2, ORDER + 1):
            number = self.at[:-1].astype(np.int64)
            number *= len(alphabet)
            number += symbol[n - 1 :]
            found = pa.array(number).dictionary_encode()
            number = None
            self.at, below = found.indices.to_numpy(), found.dictionary.to_numpy()
            self.points = np.hstack([self.points[below // len(alphabet)], alphabet[below % len(alphabet)].reshape(-1, 1)])

    def keys(self) -> pa.Array:
        """The distinct n-grams, four bytes a code point."""
        rows = np.ascontiguousarray(self.points)
        offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(4 * ORDER))
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows)])

    def counts(self) -> np.ndarray:
        """How often the texts hold each n-gram; those that end in the next text's start don't count."""
        keep = np.ones(len(self.at), bool)
        for k in range(ORDER - 1):
            keep[(self.begin + self.n)[:-1] + k] = False
        return np.bincount(self.at[keep], minlength=len(self.points))


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Rows in tables of about BLOCK characters."""
    held, size = [], 0
    for batch in batches:
        sizes, start = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist(), 0
        for i, n in enumerate(sizes):
            if size and size + n > BLOCK:
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _texts(table: pa.Table, text: int) -> list[str]:
    return [t or "" for t in table.column(text).to_pylist()]


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, count) of the highest order over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 0):
            coded = Coded(_texts(block, 0))
            total = coded.counts()
            yield pa.RecordBatch.from_arrays([coded.keys().filter(pa.array(total > 0)), pa.array(total[total > 0], pa.int64())], ["gram", "count"])

    return docs.select("text").mapInArrow(count, "gram binary, count long").groupBy("gram").agg(F.sum("count").alias("count"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What counts of 1, 2 and more lose, from the counts of counts; where those leave them undefined 0.5, 1 and 1.5."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0
    cut = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if n1 and n2 and n3 else [0.5, 1.0, 1.5]
    return [min(max(d, 0.05), k) for k, d in enumerate(cut, 1)]


@dataclass(frozen=True)
class Model:
    """Of each order n, ``seen[n]``: (gram, log_p = log10 P(last code point | those before)), and ``back[n]``: (context, the
    n - 1 code points before; log_back = log10 of its backoff weight).  ``unknown``: log10 P of a code point of which nothing is known."""

    seen: dict[int, DataFrame]
    back: dict[int, DataFrame]
    unknown: float


def _part(gram: str, start: int, n: int) -> Column:
    return F.substring(gram, 4 * start + 1, 4 * n)


def model(counts: DataFrame) -> Model:
    """counts: written (gram, count) of the highest order.  An unknown code point is one of the known ones and one more."""
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        by_order[n] = written(by_order[n + 1].groupBy(_part("gram", 1, n).alias("gram")).agg(F.count("*").alias("count")), f"counts-{n}")
    lowest = 1.0 / (by_order[1].count() + 1)
    below, seen, back = None, {}, {}
    for n in range(1, ORDER + 1):
        c = by_order[n]
        cut = discounts(*[x or 0 for x in c.agg(*[F.sum(F.when(F.col("count") == k, 1)) for k in (1, 2, 3, 4)]).first()])
        off = F.when(F.col("count") == 1, cut[0]).when(F.col("count") == 2, cut[1]).otherwise(cut[2])
        c = c.select("gram", "count", off.alias("off"), _part("gram", 0, n - 1).alias("context"), _part("gram", 1, n - 1).alias("rest"))
        contexts = written(c.groupBy("context").agg(F.sum("count").alias("total"), F.sum("off").alias("spare")), f"contexts-{n}")
        rows = c.join(contexts, "context")
        rows = rows.withColumn("p_below", F.lit(lowest)) if n == 1 else rows.join(below.select(F.col("gram").alias("rest"), F.col("p").alias("p_below")), "rest")
        below = written(rows.select("gram", ((F.col("count") - F.col("off") + F.col("spare") * F.col("p_below")) / F.col("total")).alias("p")), f"probabilities-{n}")
        seen[n] = below.select("gram", F.log10("p").cast("float").alias("log_p"))
        back[n] = contexts.select("context", F.log10(F.col("spare") / F.col("total")).cast("float").alias("log_back"))
    return Model(seen, back, float(np.log10(lowest)))


def probabilities_of(asked: DataFrame, known: Model) -> DataFrame:
    """asked: (of, at, gram).  (of, at, log_p): from the order that has the n-gram, with the backoff weights on the way
    down to it.  Only what an order hasn't goes on to the next joins."""
    rows, out = asked.withColumn("weight", F.lit(0.0).cast("float")), []
    for n in range(ORDER, 0, -1):
        found = rows.join(known.seen[n], "gram", "left")
        out.append(found.filter("log_p is not null").select("of", "at", (F.col("weight") + F.col("log_p")).alias("log_p")))
        if n == ORDER:
            # the one join of all n-grams feeds the result and the way down, which goes on with the n-grams not found
            found = written(found.select("of", "at", "weight", "log_p", F.when(F.col("log_p").isNull(), F.col("gram")).alias("gram")), "found")
            out = [found.filter("log_p is not null").select("of", "at", "log_p")]
        rest = found.filter("log_p is null").select("of", "at", "weight", _part("gram", 0, n - 1).alias("context"), _part("gram", 1, n - 1).alias("gram"))
        rows = rest.join(known.back[n], "context", "left").select("of", "at", "gram", (F.col("weight") + F.coalesce("log_back", F.lit(0.0).cast("float"))).alias("weight"))
    out.append(rows.select("of", "at", (F.col("weight") + F.lit(known.unknown)).cast("float").alias("log_p")))
    return reduce(DataFrame.unionByName, out)


def perplexities(docs: DataFrame, known: Model) -> DataFrame:
    """docs: (doc_id, text, lang).  doc_id, lang and perplexity (null for an empty text)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, block in enumerate(_blocks(batches, 1)):
            found = Coded(_texts(block, 1)).keys()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as out:
                out.write_table(block)
            name = (TaskContext.get().partitionId() << 32) + i
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bz2.compress(sink.getvalue())], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)], ["block", "packed", "grams"])

    def score(packed: pa.Table, found: pa.Table) -> pa.Table:
        block = pa.ipc.open_stream(bz2.decompress(packed.column("packed")[0].as_py())).read_all()
        coded = Coded(_texts(block, 1))
        log_p = np.zeros(len(coded.points))
        log_p[found.column("at").to_numpy()] = found.column("log_p").to_numpy()
        total = np.concatenate([[0.0], np.cumsum(log_p[coded.at])])
        mean = (total[coded.begin + coded.n] - total[coded.begin]) / np.maximum(coded.n, 1)
        return pa.table([block.column(0), block.column(2), pa.array(10.0**-mean, mask=coded.n == 0)], ["doc_id", "lang", "perplexity"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    blocks = written(docs.select("doc_id", "text", "lang").mapInArrow(pack, "block long, packed binary, grams array<binary>"), "blocks")
    found = probabilities_of(blocks.select(F.col("block").alias("of"), F.posexplode("grams").alias("at", "gram")), known)
    return blocks.select("block", "packed").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(score, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, perplexity double")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """scored: (lang, perplexity) of trusted documents.  (lang, every, threshold); every: the row over all languages.

    Counts of documents by step of log perplexity stand for the documents, so no task gets a language's documents.
    """
    steps = scored.filter("perplexity is not null").select("lang", F.floor(F.log10("perplexity") / STEP).alias("step")).groupBy("lang", "step").count()
    steps = steps.withColumn("every", F.lit(False)).unionByName(steps.groupBy("step").agg(F.sum("count").alias("count")).withColumns({"lang": F.lit(None).cast("string"), "every": F.lit(True)}))
    of = Window.partitionBy("every", "lang")
    steps = steps.withColumn("below", F.sum("count").over(of.orderBy("step"))).withColumn("total", F.sum("count").over(of))
    return steps.filter(F.col("below") >= quantile * F.col("total")).groupBy("every", "lang").agg(F.pow(F.lit(10.0), (F.min("step") + 1) * STEP).alias("threshold"))


def trusted_grams(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The n-gram counts of the documents whose doc_id is in ``trusted``, as a written table.  About the trusted texts alone are moved."""
    with bloom_filters(docs.sparkSession):
        return written(count_grams(docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left_semi")), "counts")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs: (doc_id, text, lang); labels: (doc_id, quality).  doc_id, lang, perplexity, threshold, keep."""
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id")
    aside = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == 0
    known = model(trusted_grams(docs, trusted.filter(~aside)))
    scored = written(perplexities(docs.withColumn("lang", F.col("lang").cast("string")), known), "perplexities")
    of = lambda some: written(thresholds(scored.join(some.hint("merge"), "doc_id", "left_semi"), quantile).withColumn("threshold", F.col("threshold") * MARGIN), "thresholds")
    limit = of(trusted.filter(aside))
    if (every := limit.filter("every").select("threshold").first()) is None:
        limit = of(trusted)
        every = limit.filter("every").select("threshold").first()
    own = limit.filter("not every").select(F.col("lang").alias("_lang"), "threshold")
    own = F.broadcast(own) if own.count() <= BROADCAST_LANGUAGES else own
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(every[0] if every else float("inf"))))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
