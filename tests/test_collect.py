"""Walks over saved pages, mappers of collected items, the publisher, gold rows and corpora on edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from echoline.operators import corpora, gold, sampling
from echoline.sources import collect
from echoline.streaming import enrichment

def now():
    return F.lit("2025-06-01 00:00:00").cast("timestamp")


def pages(folder, sizes, repeat=False):
    """Pages of a walk from new to old; the last one's cursor repeats or leads to an empty page."""
    folder.mkdir(parents=True, exist_ok=True)
    cursor, at = "*", 10_000
    for k, n in enumerate(sizes):
        following = cursor if repeat and k == len(sizes) - 1 else f"c{k}+/="
        reviews = [{"recommendationid": str(at - i), "timestamp_created": at - i} for i in range(n)]
        at -= n
        with open(collect.page_file(str(folder), cursor), "w") as file:
            json.dump({"success": 1, "cursor": following, "reviews": reviews}, file)
        cursor = following
    if not repeat:
        with open(collect.page_file(str(folder), cursor), "w") as file:
            json.dump({"success": 1, "cursor": "z", "reviews": []}, file)


def test_walk_rules(tmp_path):
    pages(tmp_path / "a", [3, 3, 2])
    count = lambda **o: sum(len(r) for _, r in collect.walk(str(tmp_path / "a"), **o))
    assert (count(), count(max_pages=2), count(since=9997), count(until=9999), count(since=9999, until=10_000)) == (8, 6, 4, 6, 1)
    assert len(list(collect.walk(str(tmp_path / "a"), since=9999))) == 1  # stops at the first older one
    assert len(list(collect.walk(str(tmp_path / "a"), since=9999, descending=False))) == 3
    pages(tmp_path / "b", [2, 2], repeat=True)
    assert sum(len(r) for _, r in collect.walk(str(tmp_path / "b"))) == 4
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "first.json").write_text('{"success": 2}')
    with pytest.raises(RuntimeError):
        list(collect.walk(str(tmp_path / "c")))
    assert list(collect.walk(str(tmp_path / "none"))) == []


def test_walk_as_source(spark, tmp_path):
    pages(tmp_path / "positive", [4, 4, 1])
    pages(tmp_path / "negative", [2])
    spark.dataSource.register(collect.ReviewWalk)
    both = spark.read.format("review_walk").option("path", f"{tmp_path / 'positive'},{tmp_path / 'negative'}").load()
    assert {r.partition: r["count"] for r in both.groupBy("partition").count().collect()} == {"positive": 9, "negative": 2}
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def drain(per_batch, **window):
        stream = spark.readStream.format("review_walk").option("path", str(tmp_path / "positive")).option("pagesPerBatch", per_batch).options(**window).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
        query.awaitTermination()
        return spark.read.schema(collect.REVIEW).parquet(out).count()

    first = drain(1)
    assert first in (0, 4) and drain(1) >= first
    for _ in range(4):
        total = drain(1)
    assert total == 9 and drain(25) == 9  # goes on behind its checkpoint, nothing twice


def test_youtube_threads(spark, tmp_path):
    comment = lambda i, **s: {"id": i, "snippet": {"publishedAt": "2025-04-24T10:00:00Z"} | s}
    page = {"videoId": "v1", "items": [
        {"snippet": {"topLevelComment": comment("a", textOriginal="hi", authorDisplayName="x", likeCount=3)}, "replies": {"comments": [comment("b", textOriginal="", textDisplay="<b>"), comment("c", publishedAt="2025-04-25T00:00:00Z")]}},
        {"snippet": {"topLevelComment": comment("d")}},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    comments = collect.youtube_comments(collect.read_threads(spark, str(tmp_path / "p.json")))
    rows = {r.id: r for r in collect.youtube_records(comments, "launch", "salt", now(), "2025-04-24", "2025-04-25").collect()}
    assert set(rows) == {"youtube:a", "youtube:b", "youtube:d"} and rows["youtube:b"].parent_id == "a" and rows["youtube:a"].parent_id is None
    assert (rows["youtube:a"].score, rows["youtube:b"].text, rows["youtube:d"].text, rows["youtube:b"].score) == (3, "<b>", "", 0)
    assert rows["youtube:b"].author_hash == rows["youtube:d"].author_hash != rows["youtube:a"].author_hash


def test_reddit_records(spark):
    comment = "array<struct<fullname: string, author: string, body: string, score: long, created_utc: double, parent_id: string, depth: int>>"
    post = [("t3_1", None, " Title", "", 5, "games", 1745496000.5, [("t1_1", "u", "b", 1, 1.0, "t3_1", 0), ("t1_2", "", None, 1, 1.0, "t1_1", 2), ("t1_3", "u", "deep", 1, 1.0, "t1_2", 3)])]
    df = spark.createDataFrame(post, f"fullname string, author string, title string, selftext string, score long, subreddit string, created_utc double, comments {comment}")
    rows = {r.id: r for r in collect.reddit_records(df, "launch", "salt", now()).collect()}
    assert set(rows) == {"reddit:t3_1", "reddit:t1_1", "reddit:t1_2"} and rows["reddit:t3_1"].text == "Title" and rows["reddit:t1_2"].text == ""
    assert rows["reddit:t3_1"].author_hash == rows["reddit:t1_2"].author_hash and rows["reddit:t1_1"].parent_id == "t3_1"


def test_reddit_search(spark):
    post = [("p1", "u", "T", "x", 5, "games", 1704067200.0), ("p2", "u", "T", None, 5, "pc", 1704153599.9), ("p3", "u", "late", "", 5, "pc", 1704153600.0), ("p1", "u", "T", "x", 5, "games", 1704067200.0), (None, "u", "T", "x", 5, "games", 1704067200.0)]
    posts = spark.createDataFrame(post, "fullname string, author string, title string, selftext string, score long, subreddit string, created_utc double")
    said = [("a", "p1"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "p2"), ("l", "p3"), ("o", "gone"), ("x", "y"), ("y", "x"), ("n", None)]
    comments = spark.createDataFrame([(i, None, None, 1, 5.9, p, "spare") for i, p in said], "fullname string, author string, body string, score long, created_utc double, parent_id string, subreddit string")
    found = collect.reddit_search(posts, comments.drop("subreddit"), "launch", "salt", now(), since="2024-01-01", until="2024-01-02")
    got = {r.id: (r.parent_id, r.context_id, r.text) for r in found.collect()}
    assert got == {
        "reddit:p1": (None, "games", "T\n\nx"), "reddit:p2": (None, "pc", "T"), "reddit:a": ("p1", "games", ""), "reddit:b": ("a", "games", ""),
        "reddit:c": ("b", "games", ""), "reddit:e": ("p2", "pc", ""),
    } and found.count() == 6
    assert {r.id for r in collect.reddit_search(posts, comments.drop("subreddit"), "t", "salt", now(), depth=0).collect()} == {f"reddit:{x}" for x in ("p1", "p2", "p3", "a", "e", "l")}
    assert collect.reddit_search(posts.limit(0), comments.drop("subreddit"), "t", "salt", now()).count() == 0


def test_window_slices(spark):
    rows = [("a", 0, 13), ("b", 5, 5), ("c", 5, None), ("d", 0, 6)]
    df = spark.createDataFrame(rows, "channel string, a long, b long").select("channel", F.timestamp_seconds(F.col("a") * 3600).alias("start"), F.timestamp_seconds(F.col("b") * 3600).alias("end"))
    got = collect.window_slices(df).select("channel", (F.unix_seconds("slice_start") / 3600).cast("int"), (F.unix_seconds("slice_end") / 3600).cast("int"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 6), ("a", 6, 12), ("a", 12, 13), ("d", 0, 6)]


def test_publisher(spark):
    df = spark.createDataFrame([(i, bytearray(str(i).encode()), {"k": str(i)}, float(i % 2)) for i in (3, 1, 2)], "n int, data binary, attributes map<string,string>, sleep_s double").repartition(3)
    sent, slept, fails = [], [], [1, 1]

    def send(data, attributes):
        if data == b"2" and fails:
            fails.pop()
            raise OSError("busy")
        sent.append((data, attributes["k"]))

    assert collect.publish(df, ["n"], send, sleep=slept.append, waits="sleep_s") == 3
    assert [d for d, _ in sent] == [b"1", b"2", b"3"] and slept == [1.0, 1.0, 2.0, 1.0]
    with pytest.raises(OSError):
        collect.publish(df, ["n"], lambda *x: (_ for _ in ()).throw(OSError()), attempts=2, sleep=slept.append)


def test_gold_cases(spark):
    old = spark.createDataFrame([("a", "en", " POS ", "holdout"), ("b", "fr", "neg", None), ("c", "en", "neu", "other")], "id string, language string, label string, split string")
    review = [("a", "en", "neg", "pos", "true", 0), ("n1", "en", "", "neu", "true", 1), ("n1", "en", "Pos", "neu", "1", 2), ("n1", "en", "neg", "neg", "no", 3), ("n2", "fr", None, "NEG", "no", 4), ("n3", "en", None, "maybe", "yes", 5), (" ", "en", "pos", "pos", "no", 6), ("n4", "de", "neu", "bad", "no", 7)]
    df = spark.createDataFrame(review, "id string, language string, label string, label_llm string, review_required string, position int")
    got = {r.id: (r.label, r.label_source, r.split) for r in gold.merge_gold(old, df, holdout_target=2, dev_n=1).collect()}
    assert got["a"] == ("pos", "human", "holdout") and got["b"] == ("neg", "human", "train") and got["c"][2] == "train" and set(got) == {"a", "b", "c", "n1", "n2", "n4"}
    assert got["n1"][:2] == ("pos", "human") and got["n2"] == ("neg", "llm", "train") and {got["n1"][2], got["n4"][2]} == {"holdout", "dev"}
    assert "n2" not in {r.id for r in gold.merge_gold(old, df, holdout_target=2, dev_n=1, human_only=True).collect()}
    assert gold.dropped_unreviewed(old, df).first()[0] == 2
    agreement = gold.prelabel_agreement(gold.resolved(old, df)).first()
    assert (agreement.n, agreement.accuracy) == (1, 0.0)
    with pytest.raises(Exception, match="label_llm must be"):
        sampling.resolve_review(spark.createDataFrame([("x", "", "maybe", "no")], "id string, label string, label_llm string, review_required string")).collect()
    with pytest.raises(Exception, match="gold label must be"):
        gold.existing_gold(old.withColumn("label", F.lit("good"))).collect()
    rows = spark.createDataFrame([(f"r{i}", "en" if i < 80 else ["fr", "de", "es"][i % 3], "pos") for i in range(100)], "id string, language string, label string")
    picked = gold.pick_stratified(rows, 20)
    assert picked.count() == 20 and picked.where("language <> 'en'").count() == 10 and picked.where("language <> 'en'").select("language").distinct().count() == 3
    assert gold.pick_stratified(rows, 500).count() == 100 and gold.pick_stratified(rows, 0).count() == 0


def test_seats_by_plain_rules(spark):
    from hashlib import md5

    def pick(rows, n, seed=33):
        quota, groups = max(1, n // len({g for _, _, g in rows} or {0})), {}
        order = lambda r: (md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])
        for r in sorted(rows, key=order):
            groups.setdefault(r[2], {}).setdefault(r[1], []).append(r)
        early = [r for langs in groups.values() for r in sorted(((k, lang, x) for lang, xs in langs.items() for k, x in enumerate(xs)), key=lambda t: t[:2])[:quota]]
        early = {x[0] for _, _, x in early}
        return {r[0] for r in sorted(rows, key=lambda r: (r[0] not in early, order(r)))[:n]}

    made = [(f"r{i}", ["en", "en", "en", "fr", "de", "", None][i % 7], ["pos", "neg", "neu"][i * i % 5 % 3]) for i in range(90)]
    df = spark.createDataFrame(made, "id string, language string, label string")
    plain = [(i, lang or "und", f"{label}|{'en' if lang == 'en' else 'non-en'}") for i, lang, label in made]
    for holdout_n, dev_n in [(20, 7), (0, 5), (5, 0), (80, 40), (0, 0)]:
        holdout = pick(plain, holdout_n)
        dev = pick([r for r in plain if r[0] not in holdout], dev_n)
        want = {i: "holdout" if i in holdout else "dev" if i in dev else "train" for i, _, _ in plain}
        assert {r.id: r.split for r in gold.allocate_splits(df, holdout_n, dev_n).collect()} == want
    again = gold.allocate_splits(df.unionByName(df.limit(10)), 20, 7).groupBy("id").agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"))
    assert again.where("k > 1").count() == 0 and again.agg(F.sum("n")).first()[0] == 100
    assert gold.allocate_splits(df.limit(0), 3, 2).count() == 0


def test_corpora(spark):
    rows = spark.createDataFrame([("1", "Good  @Bob", "1", "Train"), ("2", " ", "0", "train"), ("3", "x", "7", "dev")], "id string, text string, label string, split string")
    assert [(r.text, r.label, r.source) for r in corpora.mapped(rows.where("id < 3"), "sst2").collect()] == [("Good @user", "pos", "sst2")]
    with pytest.raises(Exception, match="sst2 has no label"):
        corpora.mapped(rows, "sst2").collect()
    held = spark.createDataFrame([("1", "a", "pos", " HOLDOUT", ""), ("2", "b", "neg", None, "s"), ("3", "", "neg", "dev", "s")], "id string, text string, label string, split string, source string")
    assert [(r.id, r.source) for r in corpora.own_domain(held).collect()] == [("2", "s")] and corpora.gold_rows(held, keep="Holdout").first().source == "own_domain"
    with pytest.raises(Exception, match="both text and label"):
        corpora.gold_rows(held, keep="dev").collect()
    assert corpora.stage2_rows(held, held, 3, 0).count() == 3


def test_registered_views(spark, sf_dir):
    from echoline import bridge
    from echoline.plans import views
    from echoline.session import session

    assert session().conf.get("spark.sql.session.timeZone") == "UTC"
    events = bridge.events(spark, sf_dir)
    views.register(events)
    assert spark.sql("SELECT sum(records) FROM v_sentiment_daily").first()[0] == events.count()
    assert enrichment.daily_sentiment(events).agg(F.sum("records")).first()[0] == events.count()
