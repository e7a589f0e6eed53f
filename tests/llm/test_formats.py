"""Files of other writers, damaged ones, shards on disk, searches with repeated ids."""

import hashlib
import struct

import numpy as np
from pyspark.sql import functions as F

from echoline.llm import media, sharding, topk, warc


def test_other_avi_files(spark):
    payload = media.padded(bytes(range(256)) * 30)
    own = media.write_avi(payload)
    bare = own.replace(b"strd", b"JUNK", 1)
    frames = np.random.default_rng(0).integers(0, 256, (2, media.HEIGHT, media.WIDTH), np.uint8)
    movi = media._chunk(b"LIST", b"movi" + b"".join(media._chunk(b"00dc", j) for j in media.encode_frames(frames)))
    more = own + b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVIX" + movi
    colour = own.replace(b"\xff\xc3", b"\xff\xc0")
    rows = [(1, 0, own), (2, 0, bare), (3, 0, more), (4, 0, colour), (5, 0, own[:700]), (6, 0, b"not a file"), (7, 0, b""), (None, 0, None)]
    got = {r.doc_id: r for r in media.decode(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == len(rows) and got[1].status == got[2].status == got[3].status == "decoded"
    assert got[1].payload_bytes == len(payload) and got[2].payload_bytes % 1024 == 0
    assert int(got[3].feature.split(";")[0].split("=")[1]) == int(got[1].feature.split(";")[0].split("=")[1]) + 2
    assert all(got[k].status not in (None, "decoded") and got[k].feature is None and got[k].payload_sha256 is None for k in (4, 5, 6, 7, None))
    assert media.decode(media.encode(spark.createDataFrame([], "doc_id long, text string, media string"))).count() == 0


class Writer:
    """Bits with words of one length: 4 for means' classes, 8 for the other symbols."""

    MEANS = list(range(12))
    OTHERS = [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]

    def __init__(self):
        self.bits = ""

    def value(self, words, length, symbol, number, size):
        self.bits += f"{words.index(symbol):0{length}b}"
        if size:
            self.bits += f"{number if number > 0 else number + (1 << size) - 1:0{size}b}"

    def block(self, coefficients, before):
        size = abs(int(coefficients[0] - before)).bit_length()
        self.value(self.MEANS, 4, size, int(coefficients[0] - before), size)
        last = 0
        for k in np.flatnonzero(coefficients[1:]) + 1:
            run, size = int(k - last - 1), abs(int(coefficients[k])).bit_length()
            for _ in range(run // 16):
                self.value(self.OTHERS, 8, 0xF0, 0, 0)
            self.value(self.OTHERS, 8, run % 16 << 4 | size, int(coefficients[k]), size)
            last = k
        if last < 63:
            self.value(self.OTHERS, 8, 0, 0, 0)
        return int(coefficients[0])

    def done(self):
        bits, self.bits = self.bits + "1" * (-len(self.bits) % 8), ""
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def dct_tables():
    means = bytes([0, 0, 0, 12] + [0] * 12) + bytes(Writer.MEANS)
    others = bytes([0] * 7 + [162] + [0] * 8) + bytes(Writer.OTHERS)
    huffman = b"".join(bytes([k | c << 4]) + t for k in (0, 1) for c, t in enumerate((means, others)))
    scales = bytes([0] + [3 + k // 4 for k in range(64)]) + bytes([1] + [9] * 64)
    return b"\xff\xc4" + struct.pack(">H", 2 + len(huffman)) + huffman + b"\xff\xdb" + struct.pack(">H", 2 + len(scales)) + scales


def dct_image(height, width, factors, every, scans, seed, tables=True):
    """A plain writer: (JPEG, samples of the first component by the defining sums)."""
    rng, wide, high = np.random.default_rng(seed), max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    order, at, step = [], (0, 0), 1  # walk the diagonals
    while len(order) < 64:
        order.append(at)
        r, c = at[0] - step, at[1] + step
        if c > 7 or r > 7:
            at, step = ((at[0] + 1, at[1]) if c > 7 else (at[0], at[1] + 1)), -step
        elif r < 0 or c < 0:
            at, step = (max(r, 0), max(c, 0)), -step
        else:
            at = (r, c)
    blocks = []
    for h, v in factors:
        found = rng.integers(-9, 10, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < 0.15)
        found[..., 0] = rng.integers(-90, 90, found.shape[:2])
        found[0, 0, 1:] = 0
        found[0, 0, 40] = 500
        blocks.append(found)
    body = struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([k + 1, h << 4 | v, min(k, 1)]) for k, (h, v) in enumerate(factors))
    out = media.SOI + (dct_tables() if tables else b"") + b"\xff\xc0" + struct.pack(">H", 2 + len(body)) + body + b"\xff\xdd" + struct.pack(">HH", 4, every)
    for scan in scans:
        head = bytes([len(scan)]) + b"".join(bytes([k + 1, 0x11 if k else 0]) for k in scan) + bytes([0, 63, 0])
        out += b"\xff\xda" + struct.pack(">H", 2 + len(head)) + head
        if len(scan) > 1:
            units = [[(k, y * factors[k][1] + i, x * factors[k][0] + j) for k in scan for i in range(factors[k][1]) for j in range(factors[k][0])] for y in range(down) for x in range(across)]
        else:
            (k,), (h, v) = scan, factors[scan[0]]
            units = [[(k, i, j)] for i in range(-(-(-(-height * v // high)) // 8)) for j in range(-(-(-(-width * h // wide)) // 8))]
        writer, before = Writer(), dict.fromkeys(scan, 0)
        for n, unit in enumerate(units):
            if every and n and n % every == 0:
                out += writer.done() + bytes([0xFF, 0xD0 + (n // every - 1) % 8])
                before = dict.fromkeys(scan, 0)
            for k, i, j in unit:
                before[k] = writer.block(blocks[k][i, j], before[k])
        out += writer.done()
    want = np.zeros((blocks[0].shape[0] * 8, blocks[0].shape[1] * 8))
    x = np.arange(8)
    for i, row in enumerate(blocks[0]):
        for j, block in enumerate(row):
            for k, (u, w) in enumerate(order):
                size = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if w == 0 else 1) / 4
                wave = np.outer(np.cos((2 * x + 1) * u * np.pi / 16), np.cos((2 * x + 1) * w * np.pi / 16))
                want[i * 8 : i * 8 + 8, j * 8 : j * 8 + 8] += size * block[k] * (3 + k // 4) * wave
    h, v = factors[0]
    rows, columns = np.arange(height) * v // high, np.arange(width) * h // wide
    return out + media.EOI, np.clip(want + 128, 0, 255)[rows][:, columns]


def test_dct_frames(spark):
    kinds = [
        (16, 24, [(1, 1)], 0, [[0]]), (13, 21, [(1, 1)], 2, [[0]]), (35, 50, [(2, 2), (1, 1), (1, 1)], 0, [[0, 1, 2]]), (35, 50, [(2, 1), (1, 1), (1, 1)], 3, [[0, 1, 2]]),
        (19, 33, [(2, 2), (1, 1), (1, 1)], 1, [[0], [1], [2]]), (19, 33, [(1, 1), (2, 2)], 0, [[0, 1]]), (9, 9, [(2, 2)], 0, [[0]]), (8, 200, [(1, 1)], 1, [[0]]),
    ]
    for seed, kind in enumerate(kinds):
        jpeg, want = dct_image(*kind, seed)
        got = media.dct_frame(jpeg)
        assert got.shape == kind[:2] and np.abs(got - want).max() <= 0.5 + 1e-6, kind
    frames = [dct_image(16, 64, [(2, 2), (1, 1), (1, 1)], 0, [[0, 1, 2]], seed, seed < 3)[0] for seed in range(6)]
    own = media.write_avi(bytes(64))

    def film(jpegs):
        movi = media._chunk(b"LIST", b"movi" + b"".join(media._chunk(b"00dc", j) for j in jpegs))
        body = own[8 : own.index(b"LIST", own.index(b"strf"))].replace(b"strd", b"JUNK") + movi
        return b"RIFF" + struct.pack("<I", len(body)) + body

    wide = frames[0].replace(struct.pack(">HH", 16, 64), struct.pack(">HH", 65_000, 65_000))
    bad = [film([frames[0][:-40]]), film([wide]), film([frames[0], kinds and dct_image(*kinds[0], 1)[0]]), film([frames[0].replace(b"\xff\xc0", b"\xff\xc2")])]
    rng = np.random.default_rng(3)
    for _ in range(40):  # any damage gives a row
        torn = bytearray(frames[0])
        for at in rng.integers(2, len(torn), 4):
            torn[at] = rng.integers(0, 256)
        bad.append(film([bytes(torn)]))
    rows = [(1, 0, film(frames[:3])), (2, 0, film(frames[3:])), *((9 + k, 0, x) for k, x in enumerate(bad))]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.decode(df).collect()}
    assert len(got) == len(rows) and got[1].status == "decoded" and got[1].payload_bytes == 3 * 16 * 64
    assert got[1].payload_sha256 == hashlib.sha256(media.decode_frames(frames[:3]).tobytes()).hexdigest()
    assert got[2].status == "frames leave out their tables" and got[2].payload_sha256 is None
    assert all(got[k].status != "decoded" and got[k].feature is None for k in (10, 11, 12))
    told = {r.doc_id: r.status for r in media.decode(df.where("doc_id < 3"), media.SOI + dct_tables() + media.EOI).collect()}
    assert told == {1: "decoded", 2: "decoded"}


def test_search_by_row(spark):
    rows = [(100, [1.0, 2.0], "a"), (100, [3.0, 4.0], "b"), (7, [3.0, 4.0], "c"), (8, [-1.0, 0.0], "d"), (200, [0.0, 0.0], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").withColumns({"row": F.lit(1), "level": F.lit(2)})
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank", "score").collect()
    big = 1024 * 1024
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted([
        (100, 1, 7, 11 * big), (100, 2, 100, 11 * big), (100, 1, 7, 25 * big), (100, 2, 100, 11 * big), (200, 1, 7, 0), (200, 2, 8, 0)])


def test_search_prunes_nothing_needed(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6)) * np.exp(rng.normal(size=(700, 1)) * 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = np.floor(1024 * x)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=4).collect()
    for i in range(0, 700, 50):
        want = sorted((-int(a), j) for j, a in enumerate(q @ q[i]) if j != i)[:4]
        assert sorted((-r.score, r.vec_id) for r in got if r.query_id == i) == want


def test_shards_on_disk(spark, tmp_path):
    rows = [(i % 40, "x" * (i % 9 * 10), "mine", i) for i in range(120)] + [(None, None, "n", 0), (3, "y" * 5000, "big", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, depth int")
    out = sharding.assign(df.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), limit=500)
    assert out.columns == [*df.columns, "n_bytes", "shard_", "depth_", "shard_bytes", "oversize"] and out.count() == len(rows)
    assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    sharding.write_shards(df, str(tmp_path / "s"), limit=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    sizes = back.groupBy("shard_").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in sizes) == len(rows) and all(r.b <= 500 or r.n == 1 for r in sizes)


def test_archives_on_disk(spark, tmp_path):
    rows = [(1, "http://a", "<p>x", "k"), (None, "http://n", "<p>x", "k"), (None, None, None, "k"), (2, "u", "", "k"), (2, "u", "", "k"), (3, "http://c\r\nX: y", "z" * 300_000, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string").withColumn("again", F.lit(1)).repartition(2)
    for k, row in enumerate(warc.write_archives(df).collect()):
        (tmp_path / f"{k}.wacz").write_bytes(row.archive)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wacz"))
    got = warc.read_archives(files, "content").select("*", warc.page_number("record_id").alias("id"), warc.page_number("refers_to_id").alias("to")).collect()
    assert sorted((str(r.id), r.record_type, str(r.to), r.payload_bytes) for r in got) == sorted([
        ("1", "response", "None", 4), ("None", "revisit", "1", 4), ("None", "revisit", "2", 0), ("2", "response", "None", 0), ("2", "revisit", "2", 0), ("3", "response", "None", 300_000)])
    assert warc.round_trip(df.limit(0)).count() == 0
