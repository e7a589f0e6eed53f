"""Cases of the operators that the test tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from echoline.functions import text as T
from echoline.operators import evaluation, merge, sampling, tagging
from echoline.plans import checks
from echoline.schemas import EVENT_COLUMNS
from echoline.sources import archive
from echoline.streaming import enrichment


def values(df):
    return [tuple(r) for r in df.collect()]


def test_normalise(spark):
    cases = {
        "hey @Alice check this": "hey @user check this", "write me@site.com please": "write me@site.com please",
        "http://x.com and www.y.com": "http and http", "foo bar\t\tbaz": "foo bar baz", "  \x1c ": "", "a b\x85c": "a b c",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", T.normalise(F.col("t")).alias("got")).collect())


def test_stub(spark):
    cases = [("a masterpiece, loved it", "pos", 0.75), ("Buggy boring refund", "neg", 0.75), ("(amazing!!!)", "pos", 0.75), ("", "neu", 0.34), (None, "neu", 0.34)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select(T.stub_sentiment(F.col("t")).alias("s"))
    assert [(r.s.label, r.s.score) for r in df.collect()] == [c[1:] for c in cases]


def test_parse_dead_letters(spark):
    good = json.dumps({"id": "a:1", "created_utc": "2025-04-24T12:00:00+02:00", "score": "12", "voted_up": None})
    bad = [b"{", b"\xff\xfe", b"[1, 2]", b'"x"', b"42", b"null", b'{"id": "", "created_utc": "2025-04-24T12:00:00Z"}', b'{"id": "a"}',
           b'{"id": "a", "created_utc": 1745496000}', b'{"id": "a", "created_utc": "not-a-date"}']
    df = spark.createDataFrame([(bytearray(x), {"k": "v"}) for x in [good.encode(), *bad]], "data binary, attributes map<string,string>")
    parsed = enrichment.parse(df)
    assert parsed.where("error IS NULL").count() == 1
    rows = enrichment.enrich(parsed, "2025-01-01 00:00:00").select(*EVENT_COLUMNS).collect()
    assert rows[0].score == 12 and str(rows[0].created_utc) == "2025-04-24 10:00:00" and rows[0].voted_up is None
    dead = enrichment.dead_letters(parsed, "now").collect()
    assert len(dead) == len(bad) and all({"k", "dlq_error", "dlq_at"} <= set(r.attributes) for r in dead)


def test_score_coercion(spark):
    given = ['"12"', "12.9", "null", '"x"', "true"]
    df = spark.createDataFrame([(bytearray(f'{{"id": "{i}", "created_utc": "2025-01-01T00:00:00Z", "score": {v}}}'.encode()), None) for i, v in enumerate(given)], "data binary, attributes map<string,string>")
    assert [r.score for r in enrichment.parse(df).orderBy("id").collect()] == [12, 12, None, None, None]


def test_unknown_classifier():
    with pytest.raises(KeyError):
        enrichment.load_classifier("none")


def test_merge(spark):
    t = spark.createDataFrame([("a", None, 1), ("b", 5, 1), ("c", 5, 1), ("d", 5, 1), ("e", 5, 1)], "id string, f int, v int")
    s = spark.createDataFrame([("a", 9, 2), ("b", None, 2), ("c", 6, 2), ("c", 4, 3), ("d", 5, 2), ("n", 1, 2), ("n", 1, 2)], "id string, f int, v int")
    got = {r.id: (r.v, r.merge_action) for r in merge.merge_latest(t, s, "f").collect()}
    assert got == {"a": (1, "kept"), "b": (1, "kept"), "c": (2, "updated"), "d": (1, "kept"), "e": (1, "kept"), "n": (2, "inserted")}


def test_nearest_event(spark):
    cal = spark.createDataFrame([("launch", "2025-04-24"), ("controversy", "2025-04-26"), ("sweep", "2025-12-11")], "id string, date_utc string").withColumn("date_utc", F.to_date("date_utc"))
    cases = {"2025-04-24 12:00:00": "launch", "2025-04-26 06:00:00": "controversy", "2025-12-11 00:00:00": "sweep", "2025-05-15 00:00:00": "general", "2025-04-25 00:00:00": "launch", "2025-12-14 00:00:00": "sweep", "2025-12-14 00:00:01": "general"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("created_utc", F.to_timestamp("t"))
    assert {r.t: r.event_tag for r in tagging.tag_nearest(df, cal).collect()} == cases


def test_kappa_weights_thresholds(spark):
    pairs = spark.createDataFrame([("pos", "pos"), ("pos", "neu"), ("neg", "neg"), ("neu", "neu")], "a string, b string")
    assert abs(evaluation.cohen_kappa(pairs, "a", "b").first().kappa - 0.4375 / 0.6875) < 1e-12
    assert evaluation.cohen_kappa(pairs.limit(0), "a", "b").first().kappa == 0
    rows = spark.createDataFrame([("pos",)] * 8 + [("neu",)] * 2 + [("neg",)], "label string")
    assert [round(r.weight, 6) for r in evaluation.class_weights(rows).orderBy("position").collect()] == [round(11 / 3, 6), round(11 / 6, 6), round(11 / 24, 6)]
    probs = spark.createDataFrame([(0.2, 0.45, 0.35, 0.3), (0.25, 0.3, 0.45, 0.3), (0.2, 0.3, 0.5, 0.6)], "pos double, neu double, neg double, t double")
    got = [r[0] for r in probs.select(T.apply_threshold(*map(F.col, ("pos", "neu", "neg", "t")))).collect()]
    assert got == ["neg", "neg", "neu"]


def test_broken_views_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert checks.unique_key(df, "k").count() == 1
    assert checks.non_null(df, "k").count() == 1
    assert values(checks.row_conditions(df, "v < 3").select("v")) == [(3,)]
    assert checks.no_personal_columns({"x": df.withColumn("text", F.lit(""))}) == [("x", "text")]


def test_fingerprint(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "pos")], "id string, v int, sentiment_label string")
    first = merge.fingerprint(df).first()
    assert first == merge.fingerprint(df.orderBy(F.desc("id"))).first()
    assert first != merge.fingerprint(df.fillna("", ["sentiment_label"])).first()
    assert first.missing_sentiment == 1


def test_archive_round_trip(spark, sf_dir, tmp_path):
    from echoline import bridge

    raw = bridge.records(spark, sf_dir).drop("doc_id")
    places = archive.write_archive(raw, str(tmp_path / "a"), "2024-02-01 00:30:00", "b1")
    assert str(tmp_path / "a" / "s0" / "launch" / "2024/02/01/00" / "b1") in places
    back = archive.read_archive(spark, str(tmp_path / "a"))
    assert back.count() == raw.count() and raw.select(*back.columns).exceptAll(back).isEmpty()
    assert len(archive.write_archive(raw.limit(0), str(tmp_path / "b"), "2024-02-01 00:30:00", "x")) == 1
    assert not (tmp_path / "b").exists()
    assert archive.load_landing(raw, str(tmp_path / "l")) == raw.count() == archive.load_landing(raw, str(tmp_path / "l"))


def test_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("ID,Label\n1,pos\n")
    (tmp_path / "l.jsonl").write_text('{"Id": 1, "LABEL": "pos"}\n')
    (tmp_path / "no.csv").write_text("id,x\n1,2\n")
    (tmp_path / "x.csv").write_text("date_utc,metascore\n2024-01-12,92\n")
    for name in ("l.csv", "l.jsonl"):
        assert [(r.id, r.label) for r in archive.read_labels(spark, str(tmp_path / name)).collect()] == [("1", "pos")]
    with pytest.raises(ValueError):
        archive.read_labels(spark, str(tmp_path / "no.csv"))
    assert str(archive.read_baseline(spark, str(tmp_path / "x.csv")).first().date_utc) == "2024-01-12"
    archive.write_jsonl(spark.createDataFrame([("a", "pos"), ("a", "neg"), ("b", None)], "id string, pred string").coalesce(1), str(tmp_path / "p"))
    back = archive.read_jsonl(spark, str(tmp_path / "p"), "id string, pred string")
    assert {r.id: r.pred for r in evaluation.last_predictions(back, "position").collect()} == {"a": "neg", "b": None}
    ties = spark.createDataFrame([("t", "neg", 1), ("t", "pos", 1), ("t", "pos", 0)], "id string, pred string, pos int")
    assert all(evaluation.last_predictions(ties.repartition(k)).first().pred == "pos" for k in (1, 3))
    assert [str(r.date_utc) for r in archive.load_calendar(spark, {"events": [{"id": "x", "date_utc": "2024-01-01"}]}).collect()] == ["2024-01-01"]
    for bad in ({}, {"events": []}, [{"id": "a"}, {"id": "a"}]):
        with pytest.raises(ValueError):
            archive.load_calendar(spark, bad)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from echoline import bridge
    from echoline.plans.queries import _messages

    messages = _messages(spark, sf_dir)
    messages.select(F.base64("data").alias("data"), "attributes").coalesce(1).write.json(str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("landing", "dlq", "cp")]
    batch = enrichment.enrich(enrichment.parse(messages), bridge.PROCESSED)
    with pytest.raises(RuntimeError, match="no table"):
        enrichment.append(batch, where[0])
    enrichment.create_table(spark, where[0])
    with pytest.raises(RuntimeError, match="other columns"):
        enrichment.append(batch.drop("text"), where[0])
    enrichment.run_stream(spark, str(tmp_path / "in"), *where, bridge.PROCESSED)
    stream = spark.read.parquet(where[0])
    assert merge.fingerprint(stream).first() == merge.fingerprint(batch).first()
    assert spark.read.parquet(where[1]).count() == enrichment.parse(messages).where("error IS NOT NULL").count()
    with pytest.raises(RuntimeError):
        enrichment.promote(batch.limit(0), stream, bridge.records(spark, sf_dir))
    landed = stream.select("id", "event_tag")
    assert enrichment.promote(batch.limit(0), stream, landed).count() == stream.count()
    whole = enrichment.gate(landed, stream, bridge.PROCESSED).first()
    assert whole.complete and whole.staged == whole.landed == stream.count()
    assert not enrichment.gate(landed, stream, "2030-01-01 00:00:00").first().complete
    n = enrichment.gate(landed, stream, bridge.PROCESSED, "launch").first().landed
    assert enrichment.gate(landed, stream, bridge.PROCESSED, "launch", n).first().complete
    assert not enrichment.gate(landed, stream, bridge.PROCESSED, "launch", n - 1).first().complete


def test_parse_kinds(spark):
    def body(**fields):
        return bytearray(json.dumps({"id": "a", "created_utc": "2025-01-01T00:00:00Z"} | fields).encode())

    votes = {"false": True, "": False, "x": True}
    cases = [(body(voted_up=v), w) for v, w in votes.items()] + [(body(voted_up=[]), False), (body(voted_up=[0]), True), (body(voted_up={}), False), (body(voted_up=0), False), (body(voted_up=2), True), (body(voted_up=True), True), (body(voted_up=False), False), (body(voted_up=None), None), (body(), None)]
    df = spark.createDataFrame([(x, None) for x, _ in cases], "data binary, attributes map<string,string>").coalesce(1)
    rows = enrichment.parse(df).collect()
    assert [r.voted_up for r in rows] == [w for _, w in cases] and all(r.error is None for r in rows)
    odd = [body(collected_at=5), body(collected_at="soon"), body(collected_at=""), body(id=True, text=7)]
    rows = enrichment.parse(spark.createDataFrame([(x, None) for x in odd], "data binary, attributes map<string,string>").coalesce(1)).collect()
    assert [r.error for r in rows] == [None, "collected_at is not a timestamp", None, None] and rows[0].collected_at is None and (rows[3].id, rows[3].text) == ("True", "7")
    from datetime import UTC, datetime

    for t in ("20250424T120000Z", "2025-W17-4", "2025W174", "2025-04-24T12", "2025-04-24 12:00:00+02:00", "20250424", "2025-04-24T12:00:00.125Z", "2025-04-24T1230-0330", "12:00", "2025", "2025-13-01", "next week"):
        try:
            want = datetime.fromisoformat(t.replace("Z", "+00:00"))
            want = (want if want.tzinfo else want.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
        except ValueError:
            want = None
        got = spark.range(1).select(F.date_format(enrichment.iso_time(F.lit(t)), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        assert got == want, t


def test_rejected_rows(spark):
    rows = spark.createDataFrame([("a", "s", "2025-01-01", "x"), (None, "s", "2025-01-01", "x"), ("b", None, None, "x")], "id string, source string, t string, text string")
    rows = rows.withColumn("created_utc", F.to_timestamp("t")).drop("t")
    out = enrichment.rejected_rows(rows, "now").collect()
    assert sorted(r.attributes["dlq_error"] for r in out) == ["rejected by the table: required and null: id", "rejected by the table: required and null: source, created_utc"]
    assert all(b'"text":"x"' in bytes(r.data) for r in out)
    found = enrichment.alerts(spark.createDataFrame([({"created_utc": "2025-01-01T00:00:00Z"},)], "attributes map<string,string>"), rows, "2025-01-01 01:00:00", "2025-01-01 00:59:00")
    assert {r.alert: r.value for r in found.collect()} == {"backlog too old": 3600, "dead letters": 3}


def test_remote_classifier(spark):
    class Busy(Exception):
        code = 503

    calls, waits = [], []

    def predict(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise Busy()
        if any(len(t) > 300 for t in texts):
            raise ValueError("The expanded size of the tensor must match")
        return [{"label": "LABEL_2", "score": 0.9}, [0.1, 0.2, 3.0], "negative", [{"label": "neu", "score": 0.2}, {"label": "pos", "score": 0.8}]][: len(texts)]

    got = enrichment.ask(predict, ["a" * 5000, "b", "c", "d"], sleep=waits.append)
    assert [x[0] for x in got] == ["pos", "pos", "neg", "pos"] and waits == [1.0, 2.0] and len(calls[-1][0]) < 300
    for bad in ("maybe", {"label": "pos", "score": 7}, [1, 2], {}, None):
        with pytest.raises(ValueError):
            enrichment.parse_prediction(bad)
    with pytest.raises(ValueError, match="another number"):
        enrichment.ask(lambda texts: ["pos"], ["a", "b"])
    texts = ["x" * 3000, "漢" * 300 + "b" * 50, "short", "д" * 481, "", "a漢д" * 200]
    cut = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.fit_to_tokens(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in cut] == [enrichment.shortened(t, 240.0) for t in texts]
    run = enrichment.pandas_classifier(lambda: lambda texts: ["pos" for _ in texts])
    df = spark.createDataFrame([("",), ("good game",), ("  ",), ("also good",)], "t string").coalesce(1).select(run(F.col("t")).alias("s"))
    assert [(r.s.label, r.s.score) for r in df.collect()] == [("neu", 0.0), ("pos", 1.0), ("neu", 0.0), ("pos", 1.0)]
    with pytest.raises(Exception, match="not a sentiment"):
        spark.range(1).select(T.sound(F.struct(F.lit("pos").alias("label"), F.lit(1.5).alias("score")))).collect()


def test_samples(spark):
    rows = spark.createDataFrame([(str(i), "abc"[i % 3], "t") for i in range(60)], "id string, label string, text string")
    assert sampling.stratified(rows, 10, ["label"]).count() == 10
    assert sampling.stratified(rows, 10, ["label"]).select("label").distinct().count() == 3
    parts = sampling.train_eval_split(rows, 0.2).groupBy("label", "part").count().collect()
    assert sorted((r.label, r.part, r["count"]) for r in parts) == [(x, p, n) for x in "abc" for p, n in (("eval", 4), ("train", 16))]
    assert sampling.proportional(rows, 30).count() == 30


def test_collected_items(spark):
    review = [("1", ("7", "n"), "good", "english", 1745496000, None, 3)]
    df = spark.createDataFrame(review, "recommendationid string, author struct<steamid:string,personaname:string>, review string, language string, timestamp_created long, voted_up boolean, votes_up long")
    row = archive.steam_records(df, "42", "launch", "salt").first()
    assert row.id == "steam:1" and row.voted_up is False and len(row.author_hash) == 16


