"""Streams over several micro-batches, failures between writes, restarts, late rows, repeats, alerts, workers."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from echoline.functions import languages
from echoline.streaming import enrichment, event_time, sinks, watch

AT = "2025-02-01 00:00:00"


def message(i, when="2025-01-01T00:00:00Z", text="good game", **attributes):
    body = {"id": i, "source": "s", "created_utc": when, "text": text} if i else None
    data = json.dumps(body).encode() if body else b"no json"
    return {"data": base64.b64encode(data).decode(), "attributes": {"created_utc": when} | attributes}


def put(folder, name, messages, age=0):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.json"
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps(m) + "\n" for m in messages)
    os.rename(f"{folder}/.{name}", path)
    if age:
        os.utime(path, (os.path.getmtime(path) - age,) * 2)


def where(tmp_path):
    return [str(tmp_path / x) for x in ("in", "landing", "dlq", "cp")]


@pytest.mark.parametrize("broken", ["between the writes", "while files move", "before a marker"])
def test_each_batch_lands_once(spark, tmp_path, monkeypatch, broken):
    box, landing, dlq, cp = where(tmp_path)
    enrichment.create_table(spark, landing)
    for k in range(3):
        put(box, f"f{k}", [message(f"m{k}-{i}") for i in range(20)] + [message(None, n=f"{k}")], age=100 - k)
    calls = []
    if broken == "between the writes":
        real = sinks.write_once
        monkeypatch.setattr(enrichment, "write_once", lambda rows, path, *at: calls.append(path) or (_fail() if len(calls) == 4 else real(rows, path, *at)))
    else:
        what, at = ("move", 5) if broken == "while files move" else ("write_text", 3)
        real_call = getattr(sinks.Folder, what)
        monkeypatch.setattr(sinks.Folder, what, lambda *a: calls.append(a) or (_fail() if len(calls) == at else real_call(*a)))
    with pytest.raises(Exception, match="killed"):
        enrichment.run_stream(spark, box, landing, dlq, cp, AT, files_per_batch=1)
    monkeypatch.undo()
    for _ in range(2):
        enrichment.run_stream(spark, box, landing, dlq, cp, AT, files_per_batch=1)
        assert sorted(r.id for r in spark.read.parquet(landing).collect()) == sorted(f"m{k}-{i}" for k in range(3) for i in range(20))
        assert sorted(r.attributes["n"] for r in spark.read.parquet(dlq).collect()) == ["0", "1", "2"]


def _fail():
    raise RuntimeError("killed")


def test_another_checkpoint_is_another_stream(spark, tmp_path):
    box, landing, dlq, cp = where(tmp_path)
    enrichment.create_table(spark, landing)
    put(box, "f", [message("a")])
    for k in range(2):
        enrichment.run_stream(spark, box, landing, dlq, f"{cp}{k}", AT)
    assert spark.read.parquet(landing).count() == 2


def test_repeats_over_batches_and_restarts(spark, tmp_path):
    box, landing, dlq, cp = where(tmp_path)
    enrichment.create_table(spark, landing)
    run = lambda: enrichment.run_stream(spark, box, landing, dlq, cp, AT, repeats_within="1 hour", files_per_batch=1)
    put(box, "f0", [message("a"), message("a"), message("b"), message(None), message(None, other="x")], age=90)
    put(box, "f1", [message("a", "2025-01-01T00:20:00Z"), message("c", "2025-01-01T00:30:00Z")], age=80)
    run()
    ids = lambda: sorted(r.id for r in spark.read.parquet(landing).collect())
    assert ids() == ["a", "b", "c"] and spark.read.parquet(dlq).count() == 2
    put(box, "f2", [message("b", "2025-01-01T00:40:00Z"), message("d", "2025-01-01T09:00:00Z")], age=70)
    run()
    assert ids() == ["a", "b", "c", "d"]
    put(box, "f3", [message("e", "2025-01-01T09:00:00Z")], age=60)
    put(box, "f4", [message("c", "2025-01-01T09:10:00Z")], age=50)  # beyond the watermark: left to the merge
    run()
    assert ids() == ["a", "b", "c", "c", "d", "e"]


def test_windows_with_late_rows_and_a_restart(spark, tmp_path):
    box, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    day = lambda d: f"2025-01-{d:02d}T10:00:00Z"
    put(box, "f0", [message(f"a{i}", day(1 + i % 2)) for i in range(10)], age=90)
    put(box, "f1", [message("b", day(2)), message("c", day(3)), message("g", "")], age=80)  # no time: its arrival
    assert event_time.run_windows(spark, box, out, cp, files_per_batch=1) == 0
    put(box, "f2", [message("late", day(1)), message("d", day(3))], age=70)
    dropped = event_time.run_windows(spark, box, out, cp, files_per_batch=1)
    rows = {(str(r.window_start)[:10], r.records) for r in spark.read.parquet(out).collect()}
    assert dropped == 2 and rows == {("2025-01-01", 5), ("2025-01-02", 6), ("2025-01-03", 1)}
    batch = spark.read.schema("data string, attributes map<string,string>").json(box).select(F.unbase64("data").alias("data"), "attributes", F.lit("2026-01-01").cast("timestamp").alias("arrived"))
    on_time = batch.where(~F.col("data").cast("string").rlike("late|\"d\""))
    whole = event_time.window_counts(event_time.labelled(on_time)).where("window_start < '2025-02-01'")
    assert {(str(r.window_start)[:10], r.records) for r in whole.collect()} == rows


def test_alerts_on_a_running_stream(spark, tmp_path):
    box, landing, dlq, cp = where(tmp_path)
    enrichment.create_table(spark, landing)
    put(box, "f0", [message("a"), message(None)], age=5000)
    told, seen = [], watch.Watch(longest_s=-1, backlog_s=600, tell=lambda *x: told.append(x))
    enrichment.run_stream(spark, box, landing, dlq, cp, AT, watch=seen)
    os.makedirs(f"{landing}-other")
    with pytest.raises(Exception, match="no table"):
        enrichment.run_stream(spark, box, f"{landing}-other", dlq, f"{cp}2", AT, watch=seen)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(seen)
    assert set(seen.raised) == {"job failed", "run too long", "backlog too old", "dead letters"} and len(told) == 4 and seen.raised["backlog too old"] > 4000
    quiet = watch.Watch()
    put(f"{box}2", "f0", [message("z")])
    enrichment.run_stream(spark, f"{box}2", landing, dlq, f"{cp}3", AT, watch=quiet)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(quiet)
    assert quiet.raised == {}


def test_promotion_waits_for_the_drain(spark, tmp_path):
    from echoline.operators.stored import StoredTable
    from echoline.schemas import EVENTS

    box, landing, dlq, cp = where(tmp_path)
    enrichment.create_table(spark, landing)
    table = StoredTable.create(spark.createDataFrame([], EVENTS), str(tmp_path / "table"), parts=8, buckets=2)
    staging = spark.createDataFrame([(f"m{i}", "launch") for i in range(30)], "id string, event_tag string")
    run = lambda: enrichment.drain_and_promote(spark, box, landing, dlq, cp, staging, StoredTable(spark, table.folder.root), AT, AT)
    put(box, "f0", [message(f"m{i}") for i in range(20)], age=50)
    with pytest.raises(RuntimeError, match="10 of 30"):
        run()
    assert StoredTable(spark, table.folder.root).version == 0
    put(box, "f1", [message(f"m{i}", text="bad") for i in range(15, 30)], age=40)
    for _ in range(2):
        rows = run().read().collect()
        assert sorted(r.id for r in rows) == sorted(f"m{i}" for i in range(30)) and all(r.sentiment_label for r in rows)


def test_set_up_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def setup():
        import tempfile

        tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=folder)
        return lambda texts: ["pos"] * len(texts)

    rows = spark.range(640).repartition(64).select(F.lit("fine").alias("t")).select(enrichment.pandas_classifier(setup)("t").alias("s"))
    assert rows.where("s.label = 'pos'").count() == 640
    pids = [x.split("-")[0] for x in os.listdir(folder)]
    assert 0 < len(pids) == len(set(pids)) < 64


def test_stream_takes_a_fitted_detector(spark, tmp_path):
    box, landing, dlq, cp = where(tmp_path)
    enrichment.create_table(spark, landing)
    known = [("en", "the water of the house and the town")] * 25 + [("de", "das Wasser des Hauses und der Stadt")] * 25
    detect = languages.detector(languages.fit(spark.createDataFrame(known, "language string, text string")))
    texts = {"a": "the town house", "b": "der Stadt des Wassers", "c": "12 34"}
    put(box, "f", [message(i, text=t) for i, t in texts.items()])
    enrichment.run_stream(spark, box, landing, dlq, cp, AT, detect=detect)
    assert {r.id: r.language for r in spark.read.parquet(landing).collect()} == {"a": "en", "b": "de", "c": None}
