"""The stored merge: rows, plan, files, failures, old versions."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from echoline.operators import merge, stored

SCHEMA = "id string, score long, at timestamp, text string"


def rows(spark, pairs):
    return spark.createDataFrame([(i, s, t) for i, s, t in pairs], "id string, score long, t long").select("id", "score", F.timestamp_seconds("t").alias("at"), F.concat(F.lit("text of "), "id").alias("text"))


def held(df):
    return sorted(map(tuple, df.select("id", "score", "at").collect()))


@pytest.fixture
def table(spark, tmp_path):
    rng = random.Random(2)
    first = rows(spark, [(f"k{i}", i, rng.randint(0, 50)) for i in range(500)])
    return stored.StoredTable.create(first, str(tmp_path / "t"), parts=16, buckets=4).merge(first, "at")


def test_merges_as_the_frame_does(spark, table):
    rng = random.Random(3)
    for k in range(3):
        change = rows(spark, [(f"k{rng.randint(0, 700)}", 1000 * k + j, rng.choice([None, *range(80)])) for j in range(150)])
        want = held(merge.merge_latest(table.read(), change, "at"))
        table = table.merge(change, "at")
        assert held(table.read()) == want and table.version == k + 2
    assert held(stored.StoredTable(spark, table.folder.root, 1).read()) == held(stored.StoredTable(spark, table.folder.root, 1).read())
    assert table.merge(rows(spark, []), "at").version == table.version
    assert table.merge(rows(spark, [(None, 1, 1)]), "at").version == table.version


def test_target_is_not_shuffled(spark, table):
    change = rows(spark, [("k1", 5, 99), ("k2", 5, 99), ("new", 5, 99)])
    plan, touched = table.plan(change, "at")
    assert len(touched) <= 3
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = table.plan(change, "at")[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    join = text[text.index("SortMergeJoin") :]
    branches = join.split("\n")
    left = [x for x in branches[1:] if "FileScan parquet" in x or "Exchange" in x]
    assert "FileScan parquet" in left[0] and "Bucketed: true" in left[0], text  # no exchange above the target's scan
    assert {r.merge_action for r in plan.collect()} == {"inserted", "updated", "kept"}


def test_untouched_files_stay(spark, table):
    root = table.folder.root
    files = set(glob.glob(f"{root}/data/**/*.parquet", recursive=True))
    after = table.merge(rows(spark, [("k1", 5, 99)]), "at")
    changed = [p for p in after.folders if after.folders[p] != table.folders.get(p)]
    assert len(changed) == 1 and files < set(glob.glob(f"{root}/data/**/*.parquet", recursive=True))
    assert all(after.folders[p] == table.folders[p] for p in table.folders if p not in changed)
    assert held(stored.StoredTable(spark, root, 1).read()) == held(table.read())


def test_a_failed_merge_leaves_the_version_before(spark, table, monkeypatch):
    before = held(table.read())
    change = rows(spark, [(f"k{i}", -1, 99) for i in range(50)])

    def fail(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(stored.Folder, "write_text", fail)
    with pytest.raises(RuntimeError, match="killed"):
        table.merge(change, "at")
    monkeypatch.undo()
    again = stored.StoredTable(spark, table.folder.root)
    assert again.version == 1 and held(again.read()) == before
    done = again.merge(change, "at")
    assert held(done.read()) == held(merge.merge_latest(table.read(), change, "at"))
    with pytest.raises(RuntimeError, match="come first"):
        again.merge(change, "at")
    with pytest.raises(RuntimeError, match="holds a table"):
        stored.StoredTable.create(change, table.folder.root)
