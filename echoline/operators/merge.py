"""Latest row per key, the merge of a landing table into a one-row-per-id table, coverage and fingerprints."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, freshness: str, key: str = "id") -> DataFrame:
    """The freshest row per key; equal freshness is decided by the row's digest, so reruns agree.

    One aggregation that combines rows before they are shuffled; null freshness loses to any other.
    """
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    order = F.struct(F.col(freshness).isNotNull(), F.col(freshness), digest)
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.{c}").alias(c) for c in df.columns])


def merge_latest(target: DataFrame, source: DataFrame, freshness: str, key: str = "id") -> DataFrame:
    """Target after MERGE: source rows replace strictly older ones (null freshness never replaces), new keys are added."""
    fresh = latest(source, freshness, key)
    t, s = target.alias("t"), fresh.alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    take = F.col(f"t.{key}").isNull() | F.coalesce(F.col(f"s.{freshness}") > F.col(f"t.{freshness}"), F.lit(False))
    action = F.when(F.col(f"t.{key}").isNull(), "inserted").when(take, "updated").otherwise("kept")
    return both.select(*[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns], action.alias("merge_action"))


def coverage(staging: DataFrame, landing: DataFrame) -> DataFrame:
    """Staged and landed ids, landed rows, missing by count and exactly missing ids."""
    staged = staging.agg(F.countDistinct("id").alias("staged"))
    landed = landing.agg(F.countDistinct("id").alias("landed"), F.count(F.lit(1)).alias("landed_rows"))
    exact = staging.select("id").distinct().join(landing.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing_exact"))
    return staged.crossJoin(landed).crossJoin(exact).withColumn("missing", F.col("staged") - F.col("landed"))


def fingerprint(events: DataFrame, ignore: tuple[str, ...] = ("model_version", "processed_at")) -> DataFrame:
    """Order-independent digest of a set of rows: the sum of the rows' hashes, with counts."""
    columns = [c for c in events.columns if c not in ignore]
    digest = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return events.agg(
        F.sum(digest).alias("fingerprint"), F.count(F.lit(1)).alias("row_count"), F.countDistinct("id").alias("distinct_ids"),
        F.count_if(F.col("sentiment_label").isNull()).alias("missing_sentiment"),
    )


def fingerprint_md5(events: DataFrame, columns: list[str]) -> DataFrame:
    """The same over the md5 of joined column values, which other engines can compute."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("decimal(38,0)")
    return events.agg(F.sum(digest).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("row_count"), F.countDistinct("id").alias("distinct_ids"))
