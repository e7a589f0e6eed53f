"""What the queries shuffle, and that the rows stay the same for it."""

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echoline.operators import corpora, distinct, sampling
from echoline.plans import queries


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def moved(df, columns):
    """The plan's hash and range exchanges that carry one of the columns."""
    told = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [x for x in re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: (.*)", told) if re.search(rf"\b({columns})#", x)]


def shuffled(spark, run):
    """What ``run`` gives, and the bytes that all its jobs shuffled, those of rows written on the way included."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        listed = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {listed.apply(k).stageId(): listed.apply(k).shuffleWriteBytes() for k in range(listed.size())}

    last = max(stages(), default=-1)
    out = run()
    return out, sum(n for k, n in stages().items() if k > last)


@pytest.mark.parametrize(("name", "times"), [("corpus_mix", 1), ("prelabel_rows", 0)])
def test_longer_texts_shuffle_no_more_than_told(spark, no_broadcast, tmp_path, name, times):
    """Shuffled bytes grow by at most ``times`` what the texts do; the rows stay as many, as the stub may label longer texts otherwise."""
    sf_dir = "/root/testdata/sf0.01"
    for x in Path(sf_dir).iterdir():
        (tmp_path / x.name).symlink_to(x)
    (tmp_path / "documents.parquet").unlink()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.concat_ws(" ", "text", *[F.sha2(F.concat("text", F.lit(f" {k}")), 512) for k in range(16)])
    docs.withColumn("text", F.when(F.trim("text") != "", more).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    added = docs.where("trim(text) <> ''").count() * 16 * 128
    (short, few), (long, many) = [shuffled(spark, lambda d=d: queries.QUERIES[name](spark, d).collect()) for d in (sf_dir, str(tmp_path))]
    assert len(short) == len(long) > 0
    assert many - few < (times + 0.1) * added


@pytest.mark.parametrize("name", ["stage2_rows", "corpus_mix"])
def test_mixes_shuffle_gold_texts_once(spark, sf_dir, no_broadcast, name):
    carried = moved(queries.QUERIES[name](spark, sf_dir), "text")
    bounded = [x for x in carried if "_bucket#" in x]  # rows of the buckets that the sample reaches
    assert len(carried) - len(bounded) <= 2 and len(bounded) <= 2  # one of the gold's documents, one of the sample's


def test_proportional_against_a_plain_one(spark):
    rng = random.Random(4)
    rows = [(f"i{k}", rng.choice("aaaaaaaaabbbc") if k % 50 else None) for k in range(9000)]
    df = spark.createDataFrame(rows, "id string, label string").repartition(5)
    digest = lambda i: hashlib.md5(f"33:{i}".encode()).hexdigest()
    for n in (1, 2, 7, 90, 4000, 8999, 9000):
        ranks, placed = {}, []
        for i, label in sorted(rows, key=lambda r: (digest(r[0]), r[0])):
            ranks[label] = ranks.get(label, 0) + 1
            placed.append((i, label, ranks[label]))
        first = sorted(placed, key=lambda r: (r[2] > round(ranks[r[1]] * n / len(rows)), digest(r[0]), r[0]))
        assert {r.id for r in sampling.proportional(df, n, seed=33).collect()} == {r[0] for r in first[:n]}
    assert sampling.proportional(df, 0).count() == 0


def test_rows_that_a_join_leaves_out_are_not_checked(spark, no_broadcast):
    """An empty text is an error in a gold row, not in a document without a label."""
    docs = spark.createDataFrame([(1, "a b", "s"), (2, " ", "s"), (3, None, "s")], "id int, text string, source string")
    labels = spark.createDataFrame([(1, 1)], "id int, quality int")
    rows = docs.join(labels, "id").select("id", "text", F.lit("pos").alias("label"), "source", F.lit("train").alias("split"))
    assert [r.id for r in corpora.concatenate(corpora.own_domain(rows)).select("id").collect()] == [1]
    with pytest.raises(Exception, match="both text and label"):
        corpora.concatenate(corpora.own_domain(rows.withColumn("text", F.lit(" ")))).select("id").collect()


@pytest.mark.parametrize("name", ["prelabel_candidates", "prelabel_rows"])
def test_candidates_shuffle_no_text(spark, sf_dir, no_broadcast, name):
    """Neither the query's own plan nor the rounds of its dedup, whose rows were written before, carry a text."""
    assert not moved(queries.QUERIES[name](spark, sf_dir), "text")


def test_known_ids_and_given_marks(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["", " ", "\t"]) + f"i{rng.randrange(300)}", rng.choice(["", " ", "x\n", None]), rng.choice([None, *range(40)])) for _ in range(400)]
    rows += [(f"i{k % 290}", f" t{rng.randrange(250)}\n", rng.choice([None, *range(60)])) for k in range(800)]
    df = spark.createDataFrame(rows, "id string, text string, p int").repartition(6)
    known = spark.createDataFrame([(" i3",), ("i77\n",), (None,), ("none",)], "id string")
    fresh = df.where("btrim(id, ' \t\n') NOT IN ('i3', 'i77')")
    key = lambda r: (r.id.strip(), r.text.strip(), r.p)
    want = sorted(map(key, distinct.first_by_id_or_text(fresh, "p")[0].collect()), key=str)
    marked = df.withColumn("mark", distinct.text_mark(F.col("text")))
    for got in (sampling.prelabel_candidates(df, known, "p"), sampling.prelabel_candidates(marked, known, "p", "mark")):
        assert sorted(map(key, got.collect()), key=str) == want
    least = {}
    for i, t, p in (key(r) for r in fresh.where("text IS NOT NULL").collect()):
        least[i, t] = p if least.get((i, t)) is None else min(p, least[i, t]) if p is not None else least[i, t]
    place = lambda x: (x[1] is not None, x[1] or 0, x[0][0], hashlib.sha256(x[0][1].encode()).hexdigest())
    ids, texts, walked = {""}, {""}, []
    for (i, t), p in sorted(least.items(), key=place):
        if i not in ids and t not in texts:
            ids.add(i)
            texts.add(t)
            walked.append((i, t, p))
    assert want == sorted(walked, key=str) and len(want) > 100
