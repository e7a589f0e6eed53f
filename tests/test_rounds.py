"""Reply trees, joint dedup, the carried schedule, profiles and the catalog scan against plain restatements."""

import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echoline.functions import languages
from echoline.operators import distinct, sampling, tagging, trees
from echoline.plans import checks


def walk(rows):
    ids, texts, out = set(), set(), []
    for i, t, p in sorted(rows, key=lambda r: (r[2], (r[0] or "").strip(), 0)):
        i, t = (i or "").strip(), (t or "").strip()
        if i and t and i not in ids and t not in texts:
            ids.add(i)
            texts.add(t)
            out.append(p)
    return out


def test_joint_dedup_is_the_walk(spark):
    rng = random.Random(6)
    for spread in (5, 40, 400):
        rows = [(rng.choice(["", " ", "\t"]) + f"i{rng.randrange(spread)}" + rng.choice(["", "\n"]), f" t{rng.randrange(spread)}", k) for k in range(500)]
        rows += [(None, "x", 600), ("q", None, 601), (" ", "y", 602), ("q", "  ", 603), ("q", "z", 604), ("q", "z", 605)]
        rng.shuffle(rows)
        kept, rounds = distinct.first_by_id_or_text(spark.createDataFrame(rows, "id string, text string, p long").repartition(7), "p")
        assert sorted(r.p for r in kept.collect()) == sorted(walk(rows)) and rounds < 30


def test_a_chain_takes_its_rounds(spark):
    """Row k shares its id with k - 1 and its text with k + 1: every other one stays, each decided by the one before."""
    chain = [(f"i{(k + 1) // 2}", f"t{k // 2}", k) for k in range(24)]
    df = spark.createDataFrame(chain, "id string, text string, p long")
    kept, rounds = distinct.first_by_id_or_text(df, "p")
    assert sorted(r.p for r in kept.collect()) == walk(chain) == list(range(0, 24, 2)) and rounds <= 24
    with pytest.raises(RuntimeError, match="did not decide"):
        distinct.first_by_id_or_text(df, "p", max_rounds=2)
    assert distinct.first_by_id_or_text(df.limit(0), "p")[0].count() == 0


def test_a_hot_text_and_gold(spark):
    rows = spark.range(3000).select(F.col("id").alias("p"), F.concat(F.lit("i"), (F.col("id") % 1500).cast("string")).alias("id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = sampling.prelabel_candidates(rows, spark.createDataFrame([(" i0 ",), ("i3",)], "id string"), "p")
    plain = [(r.id, r.text, r.p) for r in rows.collect() if r.id not in ("i0", "i3")]
    assert sorted(r.p for r in got.collect()) == walk(plain)


def test_reply_depths(spark):
    roots = spark.createDataFrame([("p1",), ("p2",), (None,)], "id string")
    pairs = [("a", "p1"), ("b", "a"), ("c", "b"), ("d", "c"), ("o", "gone"), ("n", None), ("x", "y"), ("y", "x"), ("s", "s"), ("e", "p2"), ("e", "b"), ("f", "e"), ("b", "a"), (None, "p1")]
    got = trees.reply_depths(roots, spark.createDataFrame([(*p, 1) for p in pairs], "id string, parent_id string, depth0 int"))
    want = [("a", "p1", 0), ("b", "p1", 1), ("b", "p1", 1), ("c", "p1", 2), ("e", "p2", 0), ("e", "p1", 2), ("f", "p2", 1)]
    assert Counter((r.id, r.root, r.depth) for r in got.collect() if r.id) == Counter(want)
    assert trees.reply_depths(roots, got.limit(0).select("id", "parent_id")).count() == 0
    assert {r.id for r in trees.reply_depths(roots, spark.createDataFrame(pairs, "id string, parent_id string"), max_depth=0).collect()} >= {"a", "e"}


@pytest.mark.parametrize("partitions", [1, 8])
def test_schedule_is_one_pass(spark, partitions):
    rng, start = random.Random(9), datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(f"r{k:03d}", start + timedelta(seconds=rng.choice([0, 1, 5, 3600, 86_400]) * rng.randint(0, 40), microseconds=rng.randint(0, 3))) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, created_utc timestamp").repartition(partitions)
    want, last, total = {}, None, 0
    for i, at in sorted(rows, key=lambda r: (r[1], r[0])):
        gap = 0.0 if last is None else (at - last).total_seconds()
        sleep = min(gap / 86_400.0, 5.0) if gap > 0 else 0.0
        total, last = total + int(sleep * 1e6 + 0.5), at
        want[i] = (round(sleep, 9), total)
    out = tagging.schedule(df)
    assert {r.id: (round(r.sleep_s, 9), r.at_us) for r in out.collect()} == want
    assert tagging.schedule(df.limit(0)).count() == 0


def test_profiles(spark):
    rows = [("en", "the water of the house and the town")] * 25 + [("de", "das Wasser des Hauses und der Stadt")] * 25 + [("rare", "qqq")] * 3 + [(None, "nothing"), ("en", None)]
    profiles = languages.fit(spark.createDataFrame(rows, "language string, text string"))
    assert profiles.names == ["de", "en"]
    texts = ["the town", "der Stadt", None, "", "123 !!", "x" * 50_000, "THE  Water\nof"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", languages.detector(profiles)(F.col("t")).alias("g"))
    found = [r.g for r in got.orderBy("i").collect()]
    assert found[:5] == ["en", "de", None, None, None] and found[6] == "en" and found == profiles.best(texts)
    assert languages.Profiles([], profiles.table[:0]).best(["a"]) == [None]
    with pytest.raises(ValueError, match="more than 1"):
        languages.fit(spark.createDataFrame(rows, "language string, text string"), max_languages=1)


def test_personal_columns_are_found_in_the_catalog(spark):
    clean, raw = spark.range(1).select("id"), spark.range(1).selectExpr("id", "'x' AS Author_Hash", "'t' AS text")
    raw.createOrReplaceTempView("someone_registered_this")
    try:
        assert [x for x in checks.personal_views(spark) if x[0] == "someone_registered_this"] == [("someone_registered_this", "Author_Hash"), ("someone_registered_this", "text")]
        checks.register_views(spark, {"report_ok": clean})
        with pytest.raises(ValueError, match="report_bad"):
            checks.register_views(spark, {"report_bad": raw})
        assert not spark.catalog.tableExists("report_bad") and spark.catalog.tableExists("report_ok")
    finally:
        for name in ("someone_registered_this", "report_ok"):
            spark.catalog.dropTempView(name)


def test_marks_and_prelabel_rows(spark):
    from echoline.operators import gold

    rows = spark.createDataFrame([(f"r{i}", "en" if i % 2 else "de", ["pos", " NEG ", "neu"][i % 3], ["high", "0.4", " low", None, "0.9"][i % 5], "t") for i in range(60)], "id string, language string, label_llm string, llm_confidence string, split string")
    old = spark.createDataFrame([(f"o{i}", "Holdout") for i in range(7)], "id string, split string")
    flags = {r.id: r for r in gold.mark_review(rows, old, holdout_target=13, dev_n=4).collect()}
    seats = {r.id for r in gold.allocate_splits(rows, 6, 4, "label_llm").where("split <> 'train'").collect()}
    assert len(seats) == 10 and len(flags) == 60
    for i in range(60):
        assert flags[f"r{i}"].review_required == (i % 3 == 1 or i % 5 in (1, 2) or f"r{i}" in seats)
        assert flags[f"r{i}"].label_llm == ["pos", " NEG ", "neu"][i % 3]
    shaped = sampling.prelabel_rows(spark.createDataFrame([("a", None, "s")], "id string, text string, source string")).first()
    assert shaped.asDict() == {"id": "a", "text": "", "language": "", "event_tag": "", "label_llm": "", "llm_confidence": "", "source": "s"}
