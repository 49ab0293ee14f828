"""Block-gzip text as a Spark data source: many tasks read one file, and a region reads only its blocks.

A block-gzip file is a row of small gzip members whose headers give their sizes, so a task can start at any of them.
Without a region the file is cut into ranges of bytes.  A task looks for the first block that starts in its range and
reads lines up to the one that starts with, or before, the first block of the next range; what comes before its own first
line end belongs to the task before.  With a region and an index of positions beside the file (``.tbi``), the tasks read only
the chunks that the index lists for it, and lines outside it are left out; without an index, all ranges are read.

Files are opened with pyarrow's file systems, in the tasks, so any store that these know works.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusframe.schema import Cohort
from locusframe.sources import vcf

#: Bytes of a range, of one read, and of a block at most.
RANGE, READ, BLOCK = 32 << 20, 1 << 20, 1 << 16
#: Lines of an Arrow batch.
BATCH = 10_000


class NotBlocks(ValueError):
    """The bytes are not a block-gzip file."""


def _open(path: str):
    files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)
    return files, name


def block_size(head: bytes) -> int | None:
    """The size of the block that starts with ``head``, or None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        length = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and length == 2 and at + 6 <= end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


def unpack(block: bytes) -> bytes:
    """The text of one whole block; its checksum has to hold."""
    extra = struct.unpack_from("<H", block, 10)[0]
    text = zlib.decompress(block[12 + extra : -8], -15)
    crc, size = struct.unpack_from("<II", block, len(block) - 8)
    if zlib.crc32(text) != crc or len(text) != size:
        raise NotBlocks("a block's checksum doesn't hold")
    return text


def blocks_from(file, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the blocks from offset ``start`` on."""
    held, at = b"", start
    while at < size:
        if len(held) < BLOCK and at + len(held) < size:
            file.seek(at + len(held))
            held += file.read(min(READ, size - at - len(held)))
        n = block_size(held)
        if n is None or n > len(held):
            raise NotBlocks(f"no block at offset {at}")
        yield at, unpack(held[:n])
        held, at = held[n:], at + n


def first_block(file, start: int, size: int) -> int:
    """Offset of the first block with text that starts at ``start`` or behind it; ``size`` if there is none."""
    at = _found(file, start, size)
    for offset, text in blocks_from(file, at, size):
        if text:
            return offset
    return size


def _found(file, start: int, size: int) -> int:
    if start == 0 or start >= size:
        return min(start, size)
    file.seek(start)
    held = file.read(min(3 * BLOCK, size - start))
    at = held.find(b"\x1f\x8b\x08\x04")
    while 0 <= at <= BLOCK:
        n = block_size(held[at : at + 512])
        if n is not None and at + n <= len(held) and (start + at + n == size or block_size(held[at + n : at + n + 512]) is not None):
            try:
                unpack(held[at : at + n])
                return start + at
            except (NotBlocks, zlib.error, struct.error):
                pass  # bytes within a block that look like a header
        at = held.find(b"\x1f\x8b\x08\x04", at + 1)
    if size - start > 2 * BLOCK:
        raise NotBlocks(f"no block starts near offset {start}")
    return size


def lines_from(file, start: tuple[int, int], size: int) -> Iterator[tuple[tuple[int, int], bytes]]:
    """(place, line) from the place ``start`` on; a place is (offset of a block, offset within its text)."""
    rest, since = b"", None
    for offset, text in blocks_from(file, start[0], size):
        at = start[1] if offset == start[0] else 0
        while at < len(text):
            end, place = text.find(b"\n", at), since or (offset, at)
            if end < 0:
                rest, since = rest + text[at:], place
                break
            yield place, rest + text[at:end]
            rest, since, at = b"", None, end + 1
    if rest:
        yield since, rest


@dataclass
class Index:
    """A position index: per sequence the chunks of each bin and the least offset of each 16,384 bases."""

    names: dict[str, int]
    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[list[int]]
    columns: tuple[int, int]

    @classmethod
    def parse(cls, raw: bytes) -> Index:
        n, _, sequence, begin, _, _, _, length = struct.unpack_from("<4x8i", raw)
        names = {name.decode(): i for i, name in enumerate(raw[36 : 36 + length].split(b"\0")[:n])}
        at, bins, linear = 36 + length, [], []
        for _ in range(n):
            own: dict[int, list[tuple[int, int]]] = {}
            (count,) = struct.unpack_from("<i", raw, at)
            at += 4
            for _ in range(count):
                number, chunks = struct.unpack_from("<Ii", raw, at)
                own[number] = [struct.unpack_from("<QQ", raw, at + 8 + 16 * k) for k in range(chunks)]
                at += 8 + 16 * chunks
            (count,) = struct.unpack_from("<i", raw, at)
            bins.append(own)
            linear.append(list(struct.unpack_from(f"<{count}Q", raw, at + 4)))
            at += 4 + 8 * count
        return cls(names, bins, linear, (sequence, begin))

    def chunks(self, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
        """Merged chunks (virtual offsets) that may hold records of bases start .. end, counted from 1."""
        if chrom not in self.names:
            return []
        i, low, high = self.names[chrom], max(start, 1) - 1, end
        least = self.linear[i][min(low >> 14, len(self.linear[i]) - 1)] if self.linear[i] else 0
        wanted = {0}
        for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
            wanted |= set(range(first + (low >> shift), first + (min(high, 1 << 29) - 1 >> shift) + 1))
        found = sorted(c for b in wanted & set(self.bins[i]) for c in self.bins[i][b] if c[1] > least)
        merged: list[tuple[int, int]] = []
        for a, b in found:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged


def region_of(text: str) -> tuple[str, int, int]:
    """chrom, chrom:start-end, chrom:start or chrom:start-; positions from 1, both inclusive."""
    chrom, colon, rest = text.rpartition(":")
    if not colon or not rest.replace(",", "").replace("-", "").isdigit():
        return text, 1, 1 << 29
    first, dash, last = rest.replace(",", "").partition("-")
    return chrom, int(first or 1), int(last) if last else 1 << 29


@dataclass
class Piece(InputPartition):
    """Lines from ``start`` on.  ``first``: a line starts there; else start is an offset in the file, and the lines are those
    behind the first line end after the first block from there.  ``edge``: an offset in the file; the line that starts with
    the first block from there is the last.  ``limit``: no line that starts at this place or behind it."""

    start: tuple[int, int]
    first: bool
    edge: int | None
    limit: tuple[int, int]


class Reader(DataSourceReader):
    def __init__(self, path: str, region: str | None, width: int):
        self.path, self.region, self.width = path, region, width

    def _cut(self, start: tuple[int, int], end: int, limit: tuple[int, int]) -> list[Piece]:
        """Pieces of ``width`` bytes from a line's start on, as far as offset ``end``."""
        edges = list(range(start[0] + self.width, end, self.width))
        return [Piece(start if k == 0 else (edges[k - 1], 0), k == 0, edges[k] if k < len(edges) else None, limit) for k in range(len(edges) + 1)]

    def partitions(self) -> list[Piece]:
        files, name = _open(self.path)
        info = files.get_file_info(name)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        with files.open_input_file(name) as f:
            if info.size and block_size(f.read(min(info.size, 512))) is None:
                raise NotBlocks(f"{self.path} is not a block-gzip file")
        index = files.get_file_info(name + ".tbi")
        whole = self._cut((0, 0), info.size, (info.size, 0))
        if self.region is None or index.type != fs.FileType.File:
            return whole
        with files.open_input_file(name + ".tbi") as f:
            raw = b"".join(text for _, text in blocks_from(f, 0, index.size))
        chunks = Index.parse(raw).chunks(*region_of(self.region))
        place = lambda v: (v >> 16, v & 0xFFFF)
        return [p for a, b in chunks for p in self._cut(place(a), place(b)[0], place(b))] or [Piece((0, 0), True, None, (0, 0))]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        files, name = _open(self.path)
        size = files.get_file_info(name).size
        region = region_of(self.region) if self.region else None
        schema = pa.schema([("value", pa.string()), ("at", pa.int64())])
        with files.open_input_file(name) as f:
            start = piece.start if piece.first else (first_block(f, piece.start[0], size), 0)
            edge = (size, 0) if piece.edge is None else (first_block(f, piece.edge, size), 0)
            if start >= min(edge, piece.limit):
                return
            values, places = [], []
            for k, (place, line) in enumerate(lines_from(f, start, size)):
                if k == 0 and not piece.first:
                    continue
                if place > edge or place >= piece.limit:
                    break
                if region and not _inside(line, region):
                    continue
                values.append(line.decode("utf-8", "replace").rstrip("\r"))
                places.append(place[0] << 16 | place[1])
                if len(values) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(places, pa.int64())], schema=schema)
                    values, places = [], []
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(places, pa.int64())], schema=schema)


def _inside(line: bytes, region: tuple[str, int, int]) -> bool:
    """The record's bases of REF meet the region."""
    if line.startswith(b"#"):
        return False
    parts = line.split(b"\t", 4)
    if len(parts) < 4 or parts[0].decode() != region[0] or not parts[1].isdigit():
        return False
    pos = int(parts[1])
    return pos <= region[2] and pos + len(parts[3]) - 1 >= region[1]


class BlockText(DataSource):
    """Format ``blocktext``: (value, at), the lines of one block-gzip file and their virtual offsets.  Options: path, region
    (chrom[:start[-end]]), width (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "blocktext"

    def schema(self) -> str:
        return "value string, at long"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("region"), int(self.options.get("width", RANGE)))


def header_of(path: str) -> list[str]:
    """The lines at the start of the file that start with #; nothing behind them is read."""
    files, name = _open(path)
    size = files.get_file_info(name).size
    out = []
    with files.open_input_file(name) as f:
        for _, line in lines_from(f, (0, 0), size):
            if not line.startswith(b"#"):
                break
            out.append(line.decode("utf-8", "replace").rstrip("\r"))
    return out


def read(spark: SparkSession, path: str, region: str | None = None, width: int = RANGE) -> Cohort:
    """A cohort from one block-gzip file, or from its records in a region."""
    spark.dataSource.register(BlockText)
    source = spark.read.format("blocktext").option("width", str(width))
    if region is not None:
        source = source.option("region", region)
    lines = source.load(path).filter(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    header = header_of(path)
    return vcf.parse(spark, lines.select("value"), header, *vcf.parse_header(header))
