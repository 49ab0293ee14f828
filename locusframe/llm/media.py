"""Media columns: payloads kept as WAV samples in a content-defined chunk store.

A payload becomes 8-bit mono PCM in a WAV container.  A rolling gear hash cuts the stored form into chunks at places that
depend on the bytes around them alone, so equal stretches of different payloads give equal chunks.  Chunks are kept once
by digest (a Spark aggregate and join); a payload's ordered chunk list joins the store again, and what it puts together
is decoded, verified against the payload's digest and measured.  Chunk bytes travel compressed, against a dictionary
built from a bounded sample.

Nulls and odd cases: a null or empty text is one block of padding; a null doc_id is kept; repeated rows and equal texts
share their chunks and get equal values; payloads of any length are chunked whole; an empty table gives an empty result;
further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import hash_sample, table, written

BLOCK = 576
RATE = 8000
#: Bytes of the shortest chunk, bits of the gear hash that are zero at a cut, bytes of the longest chunk.
SHORTEST, BITS, LONGEST = 1024, 10, 16384
#: Documents, and bytes of each, from which the compression dictionary is built, and its bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 2000, 4096, 225_280
LEVEL = 16
#: Bytes of the digests that name payloads (the start of their SHA-256) and chunks.
NAME = 16
GEAR = np.random.default_rng(576).integers(0, 2**64, 256, dtype=np.uint64)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (BLOCK * max(1, -(-len(raw) // BLOCK)) - len(raw))


def encode(payload: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def chunks(data: bytes) -> list[bytes]:
    """Cuts where the gear hash of the last 64 bytes ends in ``BITS`` zeros (its high bits), SHORTEST to LONGEST apart."""
    if len(data) <= SHORTEST:
        return [data]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16, 32):  # h[i] = sum of gear[byte i-k] << k over k < 64
        h[shift:] += h[:-shift] << np.uint64(shift)
    places = np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + 1
    out, start = [], 0
    while len(data) - start > SHORTEST:
        i = np.searchsorted(places, start + SHORTEST)
        end = min(int(places[i]) if i < len(places) else len(data), start + LONGEST, len(data))
        out.append(data[start:end])
        start = end
    if start < len(data):
        out.append(data[start:])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=NAME).digest()


def feature(payload: bytes) -> str:
    """Frames, sum, energy around the middle, crossings of the middle and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"frames={len(x) // BLOCK};sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())};peak={int(np.abs(x).max())}"


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch, rows = whole.slice(at, 1000), []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, payload = payload_of(text)
                rows.append((doc_id, n, hashlib.sha256(payload).digest()[:NAME], [digest(c) for c in chunks(encode(payload))]))
            a = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.binary()), pa.array(a[3], pa.list_(pa.binary()))], ["doc_id", "n_bytes", "sha", "digests"])


def outline(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text).  doc_id, n_bytes, the start of the payload's SHA-256 and its ordered chunk digests."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_outline, "doc_id long, n_bytes long, sha binary, digests array<binary>")


def dictionary(docs: DataFrame) -> bytes:
    """Built from the first SAMPLE_BYTES of about SAMPLE documents drawn by a hash; empty if the sample is too small.  It
    changes how chunks travel, never what they hold."""
    import zstandard

    rows = hash_sample(docs, ["doc_id"], SAMPLE).filter("text is not null").select(F.substring(F.encode("text", "utf-8"), 1, SAMPLE_BYTES).alias("b")).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, sorted(bytes(r["b"]) for r in rows)).as_bytes()
    except zstandard.ZstdError:
        return b""


def chunk_store(docs: DataFrame, shared: bytes) -> DataFrame:
    """(digest, packed): each chunk once.  A task sends a chunk once however many of its documents hold it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None, write_content_size=True)
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                digests, packed = [], []
                for text in whole.slice(at, 500).column(0).to_pylist():
                    for c in chunks(encode(payload_of(text)[1])):
                        if (d := digest(c)) not in seen:
                            seen.add(d)
                            digests.append(d)
                            packed.append(packer.compress(c))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["digest", "packed"])

    return docs.select("text").mapInArrow(cut, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))


def rebuild(lists: DataFrame, shared: bytes) -> DataFrame:
    """lists: (sha, parts), the chunks of a payload in order.  Puts the media together, verifies and measures them."""
    names = ["sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, rows = whole.slice(at, 500), []
                for sha, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    media = b"".join([unpacker.decompress(p) for p in parts])
                    payload = decode(media)
                    found = hashlib.sha256(payload)
                    if found.digest()[:NAME] != sha:
                        raise ValueError(f"the media read back for payload {sha.hex()} differ from what was stored")
                    rows.append((sha, len(payload), found.hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
                a = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(a, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    return lists.select("sha", "parts").mapInArrow(read, "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_read(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text).  doc_id, n_bytes and what ``rebuild`` finds, a row a document.

    Work is done once for each distinct payload; a payload that many documents share meets them again in a join of two
    written tables, which Spark can split.
    """
    listed, shared = written(outline(docs), "chunk-lists"), dictionary(docs)
    payloads = listed.groupBy("sha").agg(F.first("digests").alias("digests"))
    wanted = payloads.select("sha", F.size("digests").alias("n"), F.posexplode("digests").alias("place", "digest"))
    found = wanted.join(chunk_store(docs, shared), "digest")
    single = found.filter("n = 1").select("sha", F.array("packed").alias("parts"))
    several = found.filter("n > 1").groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("place", "packed"))).alias("p")).select("sha", F.col("p.packed").alias("parts"))
    media = written(rebuild(single, shared).unionByName(rebuild(several, shared)), "media")
    return listed.select("doc_id", "n_bytes", "sha").join(media, "sha").drop("sha")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))
