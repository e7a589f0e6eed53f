"""Vectors beyond doubles, nested RIFF lists, packages of other writers and damaged ones."""

import gzip
import io
import json
import math
import random
import struct
import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from echoline.llm import media, topk, warc


def plain_search(rows, k):
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows}
    out = []
    for q in whole:
        if q % 100 == 0:
            hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            found = sorted((-hold(sum(a * b for a, b in zip(whole[q], whole[c], strict=True))), c) for c in whole if c != q)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [150, 200, 306])
def test_search_of_huge_values(spark, monkeypatch, most):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    rng = random.Random(most)
    rows = [(0, [10.0**most, 1.0, 2.0]), (1, [10.0**most, 1.0, 1.0]), (2, [2.0, 2.0, 2.0])]
    rows += [(3 + i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 0, 3, 8, most]) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_search(rows, 5)
    three = topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in three) == [1, 2]


def test_nested_lists_in_a_file(spark):
    own = media.write_avi(media.padded(b"x" * 5000))
    deep = b""
    for _ in range(3000):
        deep = media._chunk(b"LIST", b"deep" + deep)
    only = b"RIFF" + struct.pack("<I", len(deep) + 4) + b"AVI " + deep
    bare = own[:12] + deep + own[12:]
    bare = bare[:4] + struct.pack("<I", len(bare) - 8) + bare[8:]
    movi = own.replace(b"idx1", b"JUNK").replace(b"movi", b"movi" + b"", 1)
    got = {r.doc_id: r for r in media.decode(spark.createDataFrame([(1, 0, only), (2, 0, bare), (3, 0, movi)], "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].status == "damaged file" and got[1].feature is None and got[2].status == got[3].status == "decoded"
    assert got[2].payload_sha256 == got[3].payload_sha256 and got[2].payload_bytes == 5056


def a_record(i, payload, digest=None):
    return warc.record(i, f"http://h/{i}", payload, digest or warc.sha1_base32(__import__("hashlib").sha1(payload).hexdigest()), True, None, len(payload))


def package(members, compression=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_packages_of_other_writers(spark, compression):
    parts, lines = {"rec-0001.warc.gz": b"", "rec-0002.warc": b""}, []
    for i in range(10):
        name = sorted(parts)[i % 2]
        raw = a_record(i, f"<p>page {i}".encode() * (i + 1))
        raw = gzip.compress(raw) if name.endswith("gz") else raw
        lines.append(f"com,h)/{i} 2024 " + json.dumps({"offset": str(len(parts[name])), "length": str(len(raw)), "filename": name}))
        parts[name] += raw
    files = [(f"archive/{n}", d) for n, d in parts.items()]
    index = "\n".join(["!meta", *lines, "com,h)/x 2024 {broken", 'com,h)/y 2024 {"filename": "gone.warc", "offset": 0, "length": 9}'])
    indexed = package([*files, ("indexes/index.cdx.gz", gzip.compress(index.encode())), ("datapackage.json", b"{}")], compression)
    walked = package(files, compression)
    cut = package([("archive/a.warc.gz", gzip.compress(a_record(90, b"whole")) + gzip.compress(a_record(91, b"cut"))[:-9]), ("archive/b.warc", a_record(92, b"odd", "A" * 32))], compression)
    odd = [b"junk", b"", None, indexed[:-30], indexed[: len(indexed) // 2], package([("indexes/i.cdxj.gz", b"\x1f\x8bno")]), package([])]
    df = spark.createDataFrame([(indexed,), (walked,), (cut,), *[(x,) for x in odd]], "archive binary").repartition(2)
    rows = warc.read_archives(df).collect()
    read = [r for r in rows if r.status == "read"]
    want = [f"{warc.RECORD_PREFIX}{i}" for i in range(10)]
    assert sorted(r.record_id for r in read) == sorted(want * 2 + [f"{warc.RECORD_PREFIX}90"])
    assert all(bytes(r.payload) == f"<p>page {i}".encode() * (i + 1) for r in read if (i := int(r.record_id.rpartition(":")[2])) < 10)
    bad = sorted(r.status for r in rows if r.status != "read")
    assert [r.record_id for r in rows if "differs" in r.status] == [f"{warc.RECORD_PREFIX}92"]
    assert sum("gone.warc" in x for x in bad) == 1 and sum("cut off" in x for x in bad) == 1 and "no file" in bad and sum("no end of central" in x for x in bad) == 4
    assert sum("indexes/i.cdxj.gz" in x for x in bad) == 1 and len(bad) == 10
