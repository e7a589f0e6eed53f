"""From the driver's tables to sentiment records: deterministic rules that SQL engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import STUB_VERSION, author_hash, stub_sentiment
from .operators.tagging import tag_nearest

SALT, STRIDE = "salt", 7919
CALENDAR = [("reveal", "2024-01-05"), ("launch", "2024-01-12"), ("controversy", "2024-01-14"), ("sweep", "2024-01-24")]
COLLECTED, PROCESSED, LAUNCH = "2024-02-01 00:00:00", "2024-02-02 00:00:00", "2024-01-12 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALENDAR, "id string, date_utc string").withColumn("date_utc", F.to_date("date_utc"))


def records(spark: SparkSession, sf_dir: str, **own: Column) -> DataFrame:
    """Raw records: documents spread over the events' month by a prime stride, with labels as the authors' verdicts.

    What other tables say is gathered by document number, so a text is shuffled once.  ``own`` are more columns, computed from
    a document's row where it is read: a query that needs no more of the text shuffles none.
    """
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    numbers = docs.select("doc_id").distinct().crossJoin(F.broadcast(events.agg(F.count(F.lit(1)).alias("_n"))))
    numbers = numbers.withColumn("event_id", F.col("doc_id") * STRIDE % F.col("_n"))
    facts = numbers.join(events, "event_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    joined = docs.withColumns(own).join(facts.select("doc_id", "ts", "user_id", "value", "event_type", "quality"), "doc_id")
    source = F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))
    raw = joined.select(
        F.concat(source, F.lit(":"), F.col("doc_id").cast("string")).alias("id"), source.alias("source"),
        F.lit(None).cast("string").alias("parent_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("created_utc"),
        F.lit(COLLECTED).cast("timestamp").alias("collected_at"), author_hash(F.col("user_id").cast("string"), SALT).alias("author_hash"),
        "text", F.col("lang").alias("language"), F.floor("value").cast("long").alias("score"), F.col("event_type").alias("context_id"),
        (F.col("quality") == 1).alias("voted_up"), "doc_id", *own,
    )
    columns = [c for c in raw.columns if c not in ("voted_up", "doc_id", *own)]
    return tag_nearest(raw, calendar(spark)).select(*columns, "event_tag", "voted_up", "doc_id", *own)


def landing(spark: SparkSession, sf_dir: str, **own: Column) -> DataFrame:
    """Records, and for every seventh document a fresher copy with another score."""
    base = records(spark, sf_dir, **own)
    copies = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    again = base.withColumn("_again", F.explode(copies))
    later = F.col("collected_at") + F.when(F.col("_again") == 1, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    return again.withColumns({"collected_at": later, "score": F.col("score") + 100 * F.col("_again")}).drop("_again")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the stub's sentiment, told where the texts are read."""
    return records(spark, sf_dir, _s=stub_sentiment(F.col("text"))).withColumns({
        "sentiment_label": F.col("_s.label"), "sentiment_score": F.col("_s.score"),
        "model_version": F.lit(STUB_VERSION), "processed_at": F.lit(PROCESSED).cast("timestamp"),
    }).drop("_s")


def gold(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Labelled rows with predictions: gold from an id digest, pred from the stub, probabilities from digest parts; ``more`` of the events' columns."""
    part = lambda i: (F.conv(F.substring(F.md5("id"), i, 3), 16, 10).cast("int") + 1)
    total = part(4) + part(7) + part(10)
    pick = F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 3
    return events(spark, sf_dir).where("voted_up IS NOT NULL").select(
        "id", "doc_id", "language", "source", F.element_at(F.array(F.lit("pos"), F.lit("neu"), F.lit("neg")), pick + 1).alias("gold"),
        F.col("sentiment_label").alias("pred"), (part(4) / total).alias("p_pos"), (part(7) / total).alias("p_neu"), (part(10) / total).alias("p_neg"),
        F.when(F.col("doc_id") % 5 == 0, "holdout").when(F.col("doc_id") % 5 == 1, "dev").otherwise("train").alias("split"), *more,
    )
