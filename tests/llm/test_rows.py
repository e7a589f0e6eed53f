"""Rows that share an id, have none or repeat each other, and columns whose names the operators would use themselves."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from echoline.llm import language, mixing, substrings


def test_mixed_rows(spark):
    same = ("the same text in several rows of one id " * 3).strip()
    rows = [(1, same, f"u{i}", "a") for i in range(7)] + [(1, "another text of that id", "v", "a"), (None, same, "n", "a"), (None, same, "n", None), (5, None, "e", "a"), (6, "", "e", "b")]
    rows += [(10 + i, "some words " * (i % 5 + 1), f"w{i}", "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, source string").withColumns({"hash": F.lit(1), "base": F.lit(2), "copy": F.lit("c"), "size": F.lit(0)}).repartition(4)
    for share in (0.4, 1.5):
        plan = mixing.mix_plan(df, share=share).collect()
        assert len(plan) == len(rows)
        out = mixing.mix(df, share=share)
        assert out.columns == df.columns
        want, got = Counter(), Counter((str(r.doc_id), r.text, str(r.source)) for r in out.collect())
        texts = {(str(i), mixing_hash): t for i, t, mixing_hash in ((r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", F.xxhash64(F.lit("text"), "text").alias("h")).collect())}
        for r in plan:
            if r.repeats:
                want[(str(r.doc_id), texts[(str(r.doc_id), r.text_hash)], str(r.source))] += r.repeats
        assert got == want
    tags = Counter(r.text_hash for r in mixing.mix(df, share=1.5).where("doc_id = 1").collect())
    assert {f"u{i}" for i in range(7)} & set(tags) and max(tags.values()) <= 2
    assert mixing.mix(df.limit(0)).count() == 0


def test_identified_rows(spark):
    good, bad = "the water and the house of the old town " * 5, "123 456 !!"
    rows = [(1, good, "en", "h", "k1"), (1, bad, "en", "h", "k2"), (None, good, "en", None, "k3"), (None, bad, None, "h", "k4"), (1, good, "en", "h", "k1"), (3, None, "en", "h", "k5"), (4, "x" * 100_000 + good, "en", "h", "k6")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string").withColumn("key", F.lit(1)).withColumn("host", F.lit("x"))
    out = language.keep_identified(df)
    assert out.columns == df.columns and sorted(r.digest for r in out.collect())[:3] == ["k1", "k1", "k3"] and "k2" not in {r.digest for r in out.collect()}
    assert language.keep_identified(df.limit(0)).count() == 0
    pages = [(1, "not an address at all[", good), (2, "http://[bad", good), (3, None, good), (4, "http://www.a.example.de/x", good)]
    found = language.identify(spark.createDataFrame(pages, "doc_id long, url string, text string"), labelled=spark.createDataFrame([("en", good)], "language string, text string"), declared_col=None, url_col="url", host_col=None)
    assert all(r.language == "en" for r in found.collect()) and found.count() == 4


def plain_fusion(rows, languages, table):
    """The fused posteriors of (text, declared, host) rows, restated per row."""
    def likelihoods(text):
        raw = (text or "").encode()
        if not language.has_letters(raw):
            return None
        b = [32, *[int(language._FOLD[x]) for x in raw], 32]
        grams = [(b[i] * 7919 + b[i + 1] * 104_729 + b[i + 2] * 1_299_709) % 2**32 % language.BUCKETS for i in range(len(raw))]
        return [sum(table[k][g] for g in grams) / 3 for k in range(len(languages))] + [-np.log(language.BUCKETS) * len(grams) / 3]

    ll = [likelihoods(t) for t, _, _ in rows]
    n, counts, total = len(languages), {}, [0] * len(languages)
    for (_, _, host), x in zip(rows, ll, strict=True):
        if x is not None and int(np.argmax(x)) < n:
            total[int(np.argmax(x))] += 1
            if host is not None:
                counts.setdefault(host, [0] * n)[int(np.argmax(x))] += 1
    top = [(c + 20 / n) / (sum(total) + 20) for c in total]
    out = []
    for (_, declared, host), x in zip(rows, ll, strict=True):
        if x is None:
            out.append(("und", 1.0))
            continue
        own = counts.get(host)
        prior = top if own is None else [(c + 20 * p) / (sum(own) + 20) for c, p in zip(own, top, strict=True)]
        known = declared in languages
        joint = [x[i] + np.log(prior[i] * 0.999) + (0 if not known else np.log(0.9) if declared == languages[i] else np.log(0.1 / max(n - 1, 1))) for i in range(n)]
        joint.append(x[n] + np.log(1e-3) + (-np.log(n) if known else 0))
        best = int(np.argmax(joint))
        out.append(([*languages, "und"][best], float(1 / np.exp(np.array(joint) - joint[best]).sum())))
    return out


def test_fusion_restated(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), "source")
    extra = spark.createDataFrame([(9001, None, "en", "src0"), (9002, "... 12", "de", None), (9003, "und der die das", "xx", None)], df.schema)
    df = df.unionByName(extra)
    labelled = df.select(F.col("lang").alias("language"), "text").where("language <> 'xx'")
    languages, table = language.fit(labelled, 2000)
    rows = df.orderBy("doc_id").collect()
    want = plain_fusion([(r.text, r.lang, r.source) for r in rows], languages, table)
    got = {r.doc_id: r for r in language.identify(df, labelled=labelled).collect()}
    for r, (name, posterior) in zip(rows, want, strict=True):
        assert got[r.doc_id].language == name and abs(got[r.doc_id].posterior - posterior) < 1e-6


def test_held_out_languages(spark):
    """Fitted on even ids, scored on odd ones, without declarations and hosts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    even = docs.where("doc_id % 2 = 0").select(F.col("lang").alias("language"), "text")
    found = language.identify(docs.where("doc_id % 2 = 1"), labelled=even, declared_col=None, host_col=None)
    share = found.join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert share >= 0.99


def test_removed_rows(spark):
    unit = "one sentence of more than eight words stands here for all."
    rows = [(7, f"{unit} and the rest of the first text of that id"), (7, f"cut me not {unit}"), (None, f"{unit} without an id"), (None, f"{unit} without an id, the other"), (8, None), (9, ""), (10, f"{unit}\n{unit}")]
    df = spark.createDataFrame([(i, t, k, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, `cut` int, `a.b` string").repartition(3)
    spans = substrings.duplicate_spans(df)
    out = substrings.remove(df, spans)
    assert out.columns == df.columns
    got = {r["cut"]: r.text for r in out.collect()}
    assert got[0] == rows[0][1] and got[1] == rows[1][1].replace(unit, unit) and got[4] is None and got[5] == ""
    assert got[2] == " without an id" and got[3] == " without an id, the other" and got[6] == "\n"
    assert substrings.duplicate_spans(df.limit(0)).count() == 0
