"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

A rotation learned on a bounded sample (principal axes, then alternating between signs and an orthogonal fit) turns each
vector into a code of up to 64 bits; one more coordinate makes nearness in angle follow the inner product.  Every row is
indexed: each shard keeps one table a substring of 8 bits.  Two codes within Hamming radius r differ by at most r // m in
one of their m substrings, so probing the buckets that near in each table finds every code in the radius; the survivors
of the full distance are ranked by the inner product of the original vectors in double precision.  The radius is the one
that holds the neighbours within the sample; where a shard has fewer than k codes in it, it grows until it holds k.

Nulls and odd cases: vectors that are null, zero, hold null or non-finite components, or are not of the sample's most
frequent length take no part, as queries or candidates; a query's own vec_id is no candidate, so rows that repeat a
vec_id don't find each other; a null vec_id is no query; ties go to the smaller vec_id; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import hash_sample, table

K = 20
BITS = 64
SUB = 8
#: Rows that the rotation and the radius are learned from, about; twice as many at most.
SAMPLE = 6000
#: Share of the sample's neighbours that the radius has to hold.
HELD = 0.96
#: Shards that the index has at least, rows of one, queries of one block.
SHARDS, SHARD_ROWS, BLOCK_ROWS = 32, 65_536, 16_384


@dataclass(frozen=True)
class Codes:
    """Binary codes: the sign of (vector, lift) rotated, minus the centre."""

    longest: float
    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows x bytes) codes; queries are stretched to the longest vector's length, which doesn't change their ranking."""
        if query:
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * self.longest
        z = np.einsum("ij,jk->ik", self.lifted(x, query) - self.centre, self.rotation)
        return np.packbits(z > 0, axis=1)


POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def learn(x: np.ndarray, k: int = K, bits: int = BITS, rounds: int = 30, seed: int = 3) -> Codes:
    rng = np.random.default_rng(seed)
    longest = float(np.sqrt((x * x).sum(axis=1).max()))
    lifted = np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]])
    centre = lifted.mean(axis=0)
    d = lifted.shape[1]
    n = min(bits, max(1, (d - 1) // SUB) * SUB)
    axes = np.linalg.eigh(np.cov((lifted - centre).T) if len(x) > 1 else np.eye(d))[1][:, ::-1][:, : min(n, d)]
    z = (lifted - centre) @ axes
    turn = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(z.T @ np.sign(z @ turn))
        turn = u @ v
    rotation = axes @ turn
    if rotation.shape[1] < n:
        rotation = np.hstack([rotation, np.zeros((d, n - rotation.shape[1]))])
    codes = Codes(longest, centre, rotation, 0)
    asked = rng.permutation(len(x))[:256]
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-score, axis=1)[:, : max(1, min(k, len(x) - 1))]
    away = POPCOUNT[codes.encode(x[asked], True)[:, None, :] ^ codes.encode(x, False)[near]].sum(axis=2)
    return Codes(longest, centre, rotation, int(np.quantile(away, HELD)) if len(x) > 1 else n)


class ShardIndex:
    """One table a substring: rows sorted by its value."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.probed: dict[tuple[int, int, int], np.ndarray] = {}

    def _probe(self, j: int, value: int, reach: int) -> np.ndarray:
        """Rows whose j-th substring is within ``reach`` of the value."""
        if (got := self.probed.get((j, value, reach))) is None:
            order, starts = self.order[j], self.starts[j]
            got = self.probed[j, value, reach] = np.concatenate([order[starts[v] : starts[v + 1]] for v in np.flatnonzero(POPCOUNT[np.arange(256) ^ value] <= reach)])
        return got

    def search(self, code: np.ndarray, k: int) -> np.ndarray:
        """Rows whose code is within the radius, which grows until it holds ``k``."""
        k = min(k, len(self.codes))
        radius = self.radius
        while True:
            seen = np.zeros(len(self.codes), bool)
            for j, value in enumerate(code):
                seen[self._probe(j, int(value), radius // len(code))] = True
            rows = np.flatnonzero(seen)
            rows = rows[POPCOUNT[self.codes[rows] ^ code].sum(axis=1) <= radius]
            if len(rows) >= k:
                return rows
            radius += len(code)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v an array of doubles: not null, not zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", wrong) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shards: int = SHARDS) -> DataFrame:
    """vectors, queries: (vec_id, embedding).  query_id, rank, vec_id, score: each query's ``k`` nearest found.

    A group is one shard of rows (by hash, so equal codes spread) and one block of queries; both have a bounded size.  It
    gives at most ``k`` rows a query.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors), usable(queries)
    sample = sorted(r["v"] for r in hash_sample(rows, ["vec_id", "v"], SAMPLE).collect())
    if not sample:
        return spark.createDataFrame([], schema)
    d = int(np.bincount([len(v) for v in sample]).argmax())
    rows, asked = rows.filter(F.size("v") == d), asked.filter((F.size("v") == d) & F.col("vec_id").isNotNull())
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    codes = learn(np.array([v for v in sample if len(v) == d]), k)
    codes = Codes(max(longest, codes.longest), codes.centre, codes.rotation, codes.radius)
    n_rows, n_asked = rows.count(), asked.count()
    n_shards, n_blocks = max(shards, -(-n_rows // SHARD_ROWS)), max(1, -(-n_asked // BLOCK_ROWS))
    data = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    # ids stay integers: a column with nulls would reach pandas as doubles
    data = data.withColumns({"none": F.col("vec_id").isNull(), "vec_id": F.coalesce("vec_id", F.lit(0).cast("long"))})

    def nearest(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            ids, none, x, q = data["vec_id"].to_numpy(np.int64), data["none"].to_numpy(bool), np.array(data["v"].tolist()), np.array(asked["v"].tolist())
            index = ShardIndex(codes.encode(x, False), codes.radius)
            for query, vector, code in zip(asked["vec_id"].tolist(), q, codes.encode(q, True)):
                found = index.search(code, k + 1)
                found = found[none[found] | (ids[found] != query)]
                score = (x[found] * vector).sum(axis=1)
                at = np.lexsort((ids[found], none[found], -score))[:k]
                best = found[at]
                out.append(pd.DataFrame({"query_id": query, "vec_id": pd.arrays.IntegerArray(ids[best], none[best]), "score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = data.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
