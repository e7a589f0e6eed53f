"""Each operator against a plain restatement on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import io
import math
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoline.llm import language, lines, media, minhash, mixing, packing, queries, sharding, substrings, topk, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, key string, `size` int"
WORDS = [f"w{i}" for i in range(300)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    base = ["\n".join(sentence(rng, rng.randint(4, 25)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = list(base)
    for t in base[:15]:
        words = t.split(" ")
        for k in (0, 1, 3):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [None, "", "   ", "One", "two words", "Two words", "x" * 9000, "漢字 " * 40, "a\n\na\n"]
    rows = [(i, t, "en" if i % 3 else "de", None if i % 9 == 0 else f"s{i % 4}", len(t or ""), "clash", "k", 1) for i, t in enumerate(texts)]
    rows += [(None, "no id here, five words long", "en", "s1", 1, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), [(r[0], r[1]) for r in rows]


def grouped(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_distance(spark):
    rng, pairs = random.Random(5), []
    for _ in range(200):
        a = "".join(rng.choice("abé 漢") for _ in range(rng.randint(1, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abé")) if rng.random() < 0.5 else b and b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b) or "z"))
    got = spark.createDataFrame(pairs, "p string, t string").select("p", "t", lines.within(F.col("p"), F.col("t")).alias("w")).collect()
    assert all(r.w == (distance(r.p, r.t) <= 2) for r in got)


def test_line_classes(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 5)
    rng = random.Random(9)
    stem = "".join(rng.choice("abcdefgh ") for _ in range(50)).strip()
    pool = [stem]
    for _ in range(60):
        x = list(stem)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        pool.append("".join(x))
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(3))) for i in range(50)] + [(90, None), (91, ""), (92, "\n\n"), (None, stem), (93, "q" * 60)]
    got = lines.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    seen = [(k, i, x.strip(lines.BLANK)) for k, t in docs if t for i, x in enumerate(t.split("\n")) if x]
    unique = sorted({x for *_, x in seen})
    edges = [(a, b) for i, a in enumerate(unique) for b in unique[i + 1 :] if len(a) >= 20 and len(b) >= 20 and distance(a, b) <= 2]
    group, degree, first = grouped(unique, edges), Counter(x for e in edges for x in e), {}
    for k, i, x in sorted(seen, key=lambda o: (o[0] is None, o[0] or 0, o[1])):
        first.setdefault(group[x], (k, i))
    want = sorted((str(k), i, *map(str, first[group[x]]), degree[x], (k, i) == first[group[x]]) for k, i, x in seen)
    assert sorted((str(r.doc_id), r.line_no, str(r.class_doc_id), str(r.class_line_no), r.n_links, r.kept) for r in got) == want
    assert len({len(unique)}) and edges


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).tolist(), 1) for i in range(250)] + [(300, [1.0] * 12, 0), (301, [1.0] * 12, 0), (302, None, 0), (None, [1.0] * 12, 0)]
    rows += [(303, [float("nan")] * 12, 0), (304, [None] * 12, 0), (305, [1.0] * 3, 0), (400, [1e30] * 12, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q in (0, 100, 200, 300, 400):
        scores = [(-hold(sum(a * b for a, b in zip(usable[q], v, strict=True))), i) for i, v in usable.items() if i != q and len(v) == 12]
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:10]]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_mixing(spark, corpus):
    df, rows = corpus
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, want = 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weights[s] for s in sizes if s not in want)
        over = [s for s in sizes if s not in want and level * weights[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
    for s in sizes:
        assert math.isclose(target[s], want.get(s, level * weights[s])) and abs(taken[s] - target[s]) <= 2
        assert sizes[s] == {r.source: r.source_size for r in got}[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(df).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(1)
    stems = {"en": ["the", "and", "water", "house"], "de": ["der", "und", "wasser", "haus"], "fr": ["les", "et", "eau", "maison"]}
    rows = [(i, " ".join(rng.choice(stems[x]) for _ in range(rng.randint(5, 40))), x, "h1") for i, x in enumerate(rng.choices(list(stems), k=150))]
    odd = [(900, None, "en", "h1"), (901, "", None, None), (902, "123 !!!", "en", "h1"), (903, "wasser", None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert sum(got[i].language == x for i, _, x, _ in rows) / len(rows) >= 0.98 and all(got[i].kept for i, *_ in rows)
    assert [got[i].language for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    blind = language.identify(df.where("doc_id < 900"), labelled=df.select(F.col("lang").alias("language"), "text"), declared_col=None, host_col=None)
    assert sum(r.language == rows[r.doc_id][2] for r in blind.collect()) / len(rows) >= 0.98
    assert {r.doc_id for r in language.keep_identified(df).collect()} == {i for i, r in got.items() if r.kept}
    assert language.identify(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><p>wasser und haus</p>')], "page_id long, url string, html string")
    r = language.page_fields(pages).first()
    assert r.declared == "de" and r.text.split() == ["wasser", "und", "haus"]


def test_rare_language(spark):
    rng = random.Random(4)
    stems = {"en": ["the", "and", "water", "house"], "fi": ["talo", "vesi", "ja", "mutta"]}
    draw = lambda x: " ".join(rng.choice(stems[x]) for _ in range(rng.randint(20, 40)))
    rows = [(i, draw("en"), "en") for i in range(600)] + [(1000 + i, draw("fi"), "fi") for i in range(3)] + [(2000 + i, "same water", "en") for i in range(300)]
    df = spark.createDataFrame(rows + [(3000, "talo ja", ""), (3001, None, "xx")], "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in language.identify(df, train_rows=20, host_col=None).collect()}
    assert all(got[i].language == x and got[i].kept for i, _, x in rows) and got[3000].language == "fi"
    labelled = df.select(F.col("lang").alias("language"), "text")
    names, table = language.fit(labelled, 5000)
    again, once = language.fit(labelled.distinct(), 5000)
    assert names == again == ["en", "fi"] and (table == once).all()


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, rows = corpus
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, got = Tokenizer.from_file(path), packing.pack(df, path).collect()
    ids = [own.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    want = Counter()
    for (k, _), x in zip(rows, ids, strict=True):
        for n, (a, length) in enumerate(packing.cut(len(x))):
            want[(k, n, a, length, zlib.crc32(np.array(x[a : a + length], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert len(bins) <= 1.02 * math.ceil(sum(map(len, ids)) / packing.SEQUENCE) + 1
    assert packing.pack(df.limit(0), path).count() == 0
    special = packing.encoder(path)("a<|endoftext|>b")
    assert special.tolist() == own.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_media(spark, corpus):
    df, rows = corpus
    got = media.decode(media.encode(df)).collect()
    assert len(got) == len(rows)
    payloads = {k: media.padded((t or "").encode()) for k, t in rows}
    for r in got:
        p = payloads[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.clips[0].first_frame == 0 and all(a.end_frame == b.first_frame for a, b in zip(r.clips, r.clips[1:], strict=False))
    frames = np.random.default_rng(0).integers(0, 256, (3, media.HEIGHT, media.WIDTH), np.uint8)
    jpegs = media.encode_frames(frames)
    assert (media.decode_frames(jpegs) == frames).all()
    slow = [media._slow(media._parse(j)[2], media._parse(j)[0], frames[0].size).astype(np.uint8) for j in jpegs]
    assert (media._undo(np.stack(slow).reshape(frames.shape)) == frames).all()
    still = np.concatenate([np.full((10, 16, 64), 20, np.uint8), np.full((10, 16, 64), 200, np.uint8)])
    assert media.shots(still) == [(0, 10), (10, 20)]
    assert media.clip_rows(media.decode(media.encode(df))).count() >= len(rows)


def test_media_stored(spark, sf_dir):
    from pathlib import Path

    from echoline.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("llm-*"))
    df = queries.op6_media_columns(spark, sf_dir)
    stored = set(folder.glob("llm-*")) - before
    assert len(stored) == 1 and df.inputFiles() and all(stored.copy().pop().name in f for f in df.inputFiles())
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(spark, corpus):
    df, rows = corpus
    sets = {k: shingles(t) for k, t in rows if k is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = grouped(sets, edges)
    found = minhash.near_duplicates(df).collect()
    assert len(found) == len(rows) and len(edges) > 20
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], r.doc_id == group[r.doc_id])
    kept = [r.doc_id for r in minhash.keep_one(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(group.values())) and kept.count(None) == 1
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sharding(spark):
    rows = [(i % 150, i % 7 * 30) for i in range(400)] + [(None, 10), (7, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long")
    got = sharding.assign(df, limit=600).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for shard, members in by.items():
        total = sum(r.n_bytes for r in members)
        assert members[0].shard_bytes == total and (total <= 600 or len(members) == 1) and members[0].oversize == (total > 600)
        assert not any(other != shard and other.startswith(shard) for other in by)
    assert sharding.assign(df.limit(0), limit=600).count() == 0


def test_warc(spark):
    rows = [(1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é" * 5000), (9, "http://f", "<p>x"), (9, "http://f", "<p>x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).select("*", warc.page_number("record_id").alias("id"), warc.page_number("refers_to_id").alias("to")).collect()
    assert len(got) == len(rows)
    assert Counter((r.id, r.record_type, r.to) for r in got) == Counter([(1, "revisit", 9), (2, "revisit", 9), (3, "revisit", 4), (4, "response", None), (5, "response", None), (9, "response", None), (9, "revisit", 9)])
    assert {r.id: r.payload_bytes for r in got} == {1: 4, 2: 4, 3: 0, 4: 0, 5: 10_000, 9: 4}
    for wide in (True, False):
        packed = warc.write_zip([("a", b"12"), ("b", b"3" * 999)], wide)
        assert zipfile.ZipFile(io.BytesIO(packed)).testzip() is None
        found = warc.ZipDirectory(lambda at, n, p=packed: p[at : at + n], len(packed))
        at, n = found.stored_range("b")
        assert packed[at : at + n] == b"3" * 999


def test_substrings(spark, corpus):
    df, rows = corpus
    spans = substrings.duplicate_spans(df, unit="line", min_words=3)
    seen, want = {}, set()
    for k, t in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0)):
        for start, end, n, norm in substrings.units_of(t, substrings.SEPARATORS["line"], 3):
            first = seen.setdefault(norm, (k, start))
            if first != (k, start):
                want.add((k, start, end, n, *first))
    assert {tuple(r) for r in spans.drop("t").collect()} == want and want
    clean = {r.doc_id: r.text for r in substrings.remove(df, spans).collect()}
    for k, t in rows:
        cut = sorted((a, b) for x, a, b, *_ in want if x == k)
        for a, b in reversed(cut):
            t = t[:a] + t[b:]
        assert clean[k] == t


def test_passages(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    long, short = draw(60), [w + "." if i % 4 == 3 else w for i, w in enumerate(draw(80))]
    docs = [(i, " ".join(draw(rng.randint(30, 90)) + (long if i % 3 else short) + draw(rng.randint(30, 90)))) for i in range(12)]
    docs += [(20, "x " * 90), (21, " ".join(draw(70)) + ".\n" + "One sentence of more than eight words stands here. " * 2), (22, None), (23, ""), (24, " ".join(long[:24]))]
    docs += [(None, " ".join(draw(9) + [w.upper() for w in long] + draw(9)).replace(" ", " \n ")), docs[1], docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    k, seen, want, texts = substrings.RUN_WORDS, {}, defaultdict(set), {}
    for d, t in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        at, parts = 0, []
        for w in (t or "").split():
            at = t.index(w, at)
            parts.append((at, at + len(w), w.lower()))
            at += len(w)
        found = [(parts[i][0], parts[i + k - 1][1], tuple(p[2] for p in parts[i : i + k])) for i in range(len(parts) - k + 1)]
        found += [(a, b, n) for a, b, _, n in substrings.units_of(t or "", substrings.SEPARATORS["sentence"], 8)]
        for a, b, key in found:
            if seen.setdefault(key, (d, a)) != (d, a):
                want[d].update(range(a, b))
        texts[d] = t
    spans = substrings.passage_spans(df).collect()
    got = defaultdict(set)
    for r in spans:
        assert not got[r.doc_id] & set(range(r.start, r.end)) and r.words == len(texts[r.doc_id][r.start : r.end].split())
        got[r.doc_id].update(range(r.start, r.end))
    assert got == want and sum(len(x) for x in want.values()) > 3000
    planted = next(r for r in spans if r.doc_id == 4)
    whole = texts[4].index(" ".join(long))
    assert planted.start <= whole and planted.end >= whole + len(" ".join(long)) and planted.kept_doc_id == 1
    units = substrings.duplicate_spans(df).collect()
    assert all(set(range(r.start, r.end)) <= got[r.doc_id] for r in units) and not any(r.doc_id == 4 for r in units)
    assert substrings.passage_spans(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert rows and len({r.sequence_id for r in rows}) <= len(rows)
    known = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= known
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.SEQUENCE


def test_oracles(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df, found = queries.QUERIES[name](spark, d), con.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns), name
        assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(str(tuple(r)) for r in found.fetchall()), name
