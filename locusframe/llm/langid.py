"""Language identification: a byte convolutional network trained in numpy, applied to fixed-length windows of whole texts.

One layer of filters of several widths over one-hot bytes (a filter is a table of 256 weights a place), rectified, max
pooled over the window, then softmax.  A text's score for a language is the mean of its windows' probabilities.

Nulls and odd cases: a null text and one without a letter are ``und`` with score 0; a null doc_id counts as the empty
text in the split; rows with null lang or text are not learned from; without any row to learn from all is ``und``;
repeated rows get equal predictions; windows cover texts of any length; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import keeps_columns, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Windows learned from: for each language and each of 256 blocks of documents (by MD5 of doc_id) at most this many, so
#: 2560 a language; the sample that the driver gets is bounded by this.
SAMPLE = 10
EPOCHS = 8
#: Least score with which the pipeline keeps a document.
KEEP = 0.5
#: A-Z count as a-z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows x window) bytes that cover the texts, zeros after a text's end, and the number of windows a text."""
    n = np.array([max(1, -(-len(t) // window)) for t in texts], np.int64)
    joined = b"".join([t + bytes(k * window - len(t)) for t, k in zip(texts, n)])
    return FOLD[np.frombuffer(joined, np.uint8)].reshape(-1, window), n


class ByteNetwork:
    """weights: for each width an array (width, 256, filters), then its bias; last the output layer and its bias."""

    def __init__(self, filters: list[np.ndarray], biases: list[np.ndarray], out: np.ndarray, out_bias: np.ndarray):
        self.filters, self.biases, self.out, self.out_bias = filters, biases, out, out_bias
        self.pairs: list | None = None

    @classmethod
    def new(cls, labels: int, rng: np.random.Generator) -> ByteNetwork:
        return cls(
            [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.2, (FILTERS * len(WIDTHS), labels)).astype(np.float32), np.zeros(labels, np.float32),
        )

    def _tables(self) -> list:
        """Sums of the weights of two neighbouring bytes, so that a filter of width 4 takes two look-ups."""
        if self.pairs is None:
            self.pairs = [[(j, (f[j][:, None] + f[j + 1][None]).reshape(65536, FILTERS)) if j + 1 < len(f) else (j, f[j]) for j in range(0, len(f), 2)] for f in self.filters]
        return self.pairs

    def pooled(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for f, bias, parts in zip(self.filters, self.biases, self._tables()):
            n, h = x.shape[1] - len(f) + 1, None
            for j, t in parts:
                part = np.take(t, (two if len(t) > 256 else x)[:, j : j + n], axis=0)
                h = part if h is None else np.add(h, part, out=h)
            out.append(np.maximum(h.max(axis=1) + bias, 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, x: np.ndarray, at_once: int = 256) -> np.ndarray:
        out = []
        for i in range(0, len(x), at_once):
            z = self.pooled(x[i : i + at_once]) @ self.out + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.out_bias)))

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 128) -> ByteNetwork:
        """Adam on the cross entropy; through the maximum, only the place that won learns."""
        weights = [*self.filters, *self.biases, self.out, self.out_bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                hidden, places = [], []
                for f, bias in zip(self.filters, self.biases):
                    n = xb.shape[1] - len(f) + 1
                    h = f[0][xb[:, :n]]
                    for j in range(1, len(f)):
                        h += f[j][xb[:, j : j + n]]
                    places.append(h.argmax(axis=1))
                    hidden.append(np.maximum(h.max(axis=1) + bias, 0))
                pooled = np.concatenate(hidden, axis=1)
                z = pooled @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out.T) * (pooled > 0)
                grads_f, grads_b = [], []
                for k, (f, place) in enumerate(zip(self.filters, places)):
                    part, g = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
                    for j in range(len(f)):
                        np.add.at(g[j], (np.take_along_axis(xb, place + j, axis=1), np.arange(FILTERS)[None]), part)
                    grads_f.append(g)
                    grads_b.append(part.sum(axis=0))
                step += 1
                for w, g, a, b in zip(weights, [*grads_f, *grads_b, pooled.T @ p, p.sum(axis=0)], first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.pairs = None
        return self


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[list[str], ByteNetwork | None]:
    """docs: (doc_id, text, lang) of labelled rows.  One window, at a place drawn by doc_id, of at most ``sample``
    documents of each language and block; no task gets a whole language."""
    raw = F.encode("text", "utf-8")
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
    rows = docs.filter("text is not null and lang is not null").select(
        "lang", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k"), F.substring(raw, F.pmod(F.xxhash64("doc_id"), room).cast("int") + 1, F.lit(WINDOW)).alias("w")
    )
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang", F.substring("k", 1, 2)).orderBy("k", "w"))).filter(F.col("n") <= sample)
    got = rows.select("lang", "k", "w").toPandas().sort_values(["lang", "k", "w"])
    if got.empty:
        return [], None
    labels, rng = sorted(got["lang"].unique()), np.random.default_rng(seed)
    x, _ = windows_of([bytes(w) for w in got["w"]])
    y = np.searchsorted(labels, got["lang"].to_numpy())
    return labels, ByteNetwork.new(len(labels), rng).fit(x, y, rng)


def predict(docs: DataFrame, labels: list[str], network: ByteNetwork | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score to ``docs``, which has a text and keeps its columns."""
    columns = docs.columns
    checked = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if network is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    weights = (network.filters, network.biases, network.out, network.out_bias)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteNetwork(*weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                text = batch.column(batch.schema.get_field_index("text"))
                letters = np.array(batch.column(batch.schema.get_field_index("_letters")).to_pylist())
                x, n = windows_of([(t or "").encode() if ok else b"" for t, ok in zip(text.to_pylist(), letters)])
                p = np.add.reduceat(net.probabilities(x), np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
                best = p.argmax(axis=1)
                pred = [labels[b] if ok else "und" for b, ok in zip(best, letters)]
                score = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*columns, *names])

    schema = docs.schema
    return checked.mapInArrow(apply, type(schema)(list(schema)).add(names[0], "string").add(names[1], "double"))


def learned(docs: DataFrame) -> tuple[list[str], ByteNetwork | None]:
    return train(docs.filter(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), *learned(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter and those whose best language scores under ``KEEP`` go."""
    found = predict(docs, *learned(docs), names=("_lang_pred", "_lang_score"))
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= KEEP)).select(*docs.columns)
