"""Readers: block-gzip files by many tasks and by region, headers, repeated keys, round trips, side tables."""

import random
import struct
import zlib

import pytest

from locusframe.sources import blocks, side, vcf

HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]


def packed(text: bytes) -> bytes:
    """One block, by the format's description."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(text) + c.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def bin_of(start, end):
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def write_blocks(path, lines, size, seed=0, indexed=True, empty=False):
    """Lines as blocks of about ``size`` bytes, cut anywhere, and their index."""
    rng, text = random.Random(seed), "".join(line + "\n" for line in lines).encode()
    out, at, cuts = b"", 0, []
    while at < len(text):
        n = rng.randint(1, 2 * size)
        cuts.append((at, len(out)))
        out += packed(text[at : at + n])
        if empty and rng.random() < 0.3:
            out += packed(b"")
        at += n
    end = len(out)
    path.write_bytes(out + packed(b""))

    def place(t):  # a place at the end of a block is the start of the next with text
        i = max(k for k, c in enumerate(cuts) if c[0] <= t) if t < len(text) else None
        return end << 16 if i is None else cuts[i][1] << 16 | t - cuts[i][0]

    if indexed:
        names, own, linear, t = [], {}, {}, 0
        for line in lines:
            nxt = t + len(line.encode()) + 1
            if not line.startswith("#"):
                chrom, pos, _, ref = line.split("\t")[:4]
                names += [chrom] * (chrom not in names)
                start, stop = int(pos) - 1, int(pos) - 1 + len(ref)
                chunk = own.setdefault(chrom, {}).setdefault(bin_of(start, stop), [])
                if chunk and chunk[-1][1] == place(t):
                    chunk[-1][1] = place(nxt)
                else:
                    chunk.append([place(t), place(nxt)])
                for w in range(start >> 14, (stop - 1 >> 14) + 1):
                    linear.setdefault(chrom, {}).setdefault(w, place(t))
            t = nxt
        joined = b"".join(n.encode() + b"\0" for n in names)
        raw = b"TBI\1" + struct.pack("<8i", len(names), 2, 1, 2, 0, 35, 0, len(joined)) + joined
        for n in names:
            raw += struct.pack("<i", len(own[n]))
            for b, chunks in own[n].items():
                raw += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            top, last, line = max(linear[n]), 0, []
            for w in range(top + 1):
                last = linear[n].get(w, last)
                line.append(last)
            raw += struct.pack("<i", top + 1) + struct.pack(f"<{top + 1}Q", *line)
        (path.parent / (path.name + ".tbi")).write_bytes(packed(raw) + packed(b""))


def records(seed, n):
    rng, rows = random.Random(seed), []
    for chrom in ("1", "2", "X"):
        pos = 0
        for _ in range(n):
            pos += rng.randint(1, 3000)
            ref = "ACGT"[rng.randrange(4)] * rng.choice([1, 1, 1, 5])
            rows.append(f"{chrom}\t{pos}\t.\t{ref}\t{'T' if ref[0] != 'T' else 'A'}\t{rng.randint(1, 99)}\tPASS\tDP={rng.randint(1, 10**rng.randint(1, 9))}\tGT:DP\t0/1:{rng.randint(0, 99)}\t{rng.choice(['0/0', '1|1', './.'])}")
    return rows


def test_a_block_file_is_read_by_many_tasks(spark, tmp_path):
    rows = records(1, 700)
    (tmp_path / "plain.vcf").write_text("\n".join(HEAD + rows) + "\n")
    plain = vcf.read(spark, str(tmp_path / "plain.vcf"))
    for seed, size, width, empty in ((1, 300, 4000, False), (2, 3000, 20_000, True), (3, 40, 1000, True), (4, 20_000, 1 << 25, False)):
        path = tmp_path / f"b{seed}.vcf.gz"
        write_blocks(path, HEAD + rows, size, seed, empty=empty)
        got = blocks.read(spark, str(path), width=width)
        parts = got.sites.rdd.getNumPartitions()
        assert parts == -(-path.stat().st_size // width) and (parts >= 4 or seed not in (1, 3))
        columns = [c for c in plain.sites.columns if c not in ("site_id", "line_no")]
        assert [tuple(r) for r in got.sites.orderBy("line_no").select(columns).collect()] == [tuple(r) for r in plain.sites.orderBy("line_no").select(columns).collect()]
        assert got.calls.count() == 2 * len(rows) and got.header == HEAD and [f.id for f in got.fields] == ["DP"]


def test_a_region_reads_its_blocks_alone(spark, tmp_path):
    rows = records(2, 900)
    path = tmp_path / "a.vcf.gz"
    write_blocks(path, HEAD + rows, 500, 7, empty=True)
    split = [r.split("\t") for r in rows]
    for region, (chrom, low, high) in {"2:500,000-700,000": ("2", 500_000, 700_000), "X": ("X", 1, 1 << 29), "1:1000-": ("1", 1000, 1 << 29), "2:1-5000": ("2", 1, 5000), "9": ("9", 1, 2), "1:16384-16385": ("1", 16384, 16385)}.items():
        want = [(r[0], int(r[1]), r[3]) for r in split if r[0] == chrom and int(r[1]) <= high and int(r[1]) + len(r[3]) - 1 >= low]
        for width in (2000, 1 << 25):
            got = blocks.read(spark, str(path), region, width)
            assert [tuple(r) for r in got.sites.orderBy("line_no").select("chrom", "pos", "ref").collect()] == want
    reader = blocks.Reader(str(path), "2:500,000-520,000", 1 << 25)
    span = sum(p.limit[0] - p.start[0] for p in reader.partitions())
    assert 0 < span < path.stat().st_size / 20
    (tmp_path / "a.vcf.gz.tbi").unlink()  # without an index all is read and what is outside left out
    assert blocks.read(spark, str(path), "2:1-5000").sites.count() == sum(r[0] == "2" and int(r[1]) <= 5000 for r in split)


def test_other_files_are_refused(spark, tmp_path):
    import gzip

    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress("\n".join(HEAD).encode()))
    with pytest.raises(blocks.NotBlocks):
        blocks.Reader(str(tmp_path / "a.vcf.gz"), None, 100).partitions()
    whole = packed(b"x\n" * 50)
    with pytest.raises(blocks.NotBlocks):
        blocks.unpack(whole[:-8] + b"\0\0\0\0" + whole[-4:])
    (tmp_path / "b.vcf.gz").write_bytes(packed(b""))
    assert [list(b) for p in blocks.Reader(str(tmp_path / "b.vcf.gz"), None, 100).partitions() for b in blocks.Reader(str(tmp_path / "b.vcf.gz"), None, 100).read(p)] == []


def test_regions():
    assert blocks.region_of("chr1") == ("chr1", 1, 1 << 29) and blocks.region_of("chr1:5-9") == ("chr1", 5, 9)
    assert blocks.region_of("HLA:1*01") == ("HLA:1*01", 1, 1 << 29) and blocks.region_of("1:7") == ("1", 7, 1 << 29)


def test_written_cohorts_are_read_by_one_path(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("\n".join(HEAD + records(3, 40)) + "\n")
    cohort = vcf.read(spark, str(tmp_path / "a.vcf"))
    vcf.write(cohort, str(tmp_path / "out"))
    back = vcf.read(spark, str(tmp_path / "out"))
    columns = ["chrom", "pos", "ref", "alt", "qual", "filter", "info"]
    assert sorted(map(str, back.sites.select(columns).collect())) == sorted(map(str, cohort.sites.select(columns).collect()))
    assert [r.sample_id for r in back.samples.orderBy("sample_idx").collect()] == ["A", "B"] and back.calls.count() == cohort.calls.count()


def test_headers_and_repeated_keys(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("\n".join([*HEAD[:1], *(f"##contig=<ID=c{i}>" for i in range(2500)), *HEAD[1:], "1\t5\t.\tA\tC\t.\t.\t.\tGT:DP:DP\t0/1:3:4\t1/1:5:6"]) + "\n")
    c = vcf.read(spark, str(tmp_path / "a.vcf"))
    assert len(c.header) == 2503 and sorted(r.dp for r in c.calls.collect()) == [3, 5]
    (tmp_path / "b.vcf").write_text("1\t5\t.\tA\tC\t.\t.\t.\n")
    with pytest.raises(ValueError, match="#CHROM"):
        vcf.read(spark, str(tmp_path / "b.vcf"))


def test_side_tables(spark, tmp_path):
    (tmp_path / "p").write_text("#c p\n1\t5\nX  7\n1\tnone\n")
    assert [tuple(r) for r in side.positions(spark, str(tmp_path / "p")).collect()] == [("1", 5), ("X", 7)]
    (tmp_path / "s").write_text("A\n\n B \n#C\n")
    assert [r.sample_id for r in side.sample_list(spark, str(tmp_path / "s")).collect()] == ["A", "B", "#C"]
    (tmp_path / "t").write_text("FAM CHILD DAD MUM\nf1 a b c\nf2\td\te\tf\n")
    assert [tuple(r) for r in side.trios(spark, str(tmp_path / "t")).collect()] == [("f1", "a", "b", "c"), ("f2", "d", "e", "f")]
