"""Data tests: each returns the violating rows; none means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BACKGROUND, PERSONAL
from . import views


def unique_key(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def non_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def row_conditions(df: DataFrame, *conditions: str) -> DataFrame:
    """Rows that break a condition, with its text; a condition that is null passes."""
    broken = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(c)) for c in conditions])))
    return df.withColumn("broken", broken)


def no_personal_columns(frames: dict[str, DataFrame]) -> list[tuple[str, str]]:
    return [(name, c) for name, df in frames.items() for c in df.columns if c in PERSONAL]


def personal_views(spark: SparkSession, database: str | None = None) -> list[tuple[str, str]]:
    """(view, column) of the personal columns of all views and tables that are registered, session views among them."""
    found = []
    for entry in spark.catalog.listTables(database):
        full = entry.name if entry.isTemporary or not entry.namespace else f"`{entry.namespace[0]}`.`{entry.name}`"
        found += [(entry.name, c.name) for c in spark.catalog.listColumns(full) if c.name.lower() in PERSONAL]
    return sorted(found)


def register_views(spark: SparkSession, frames: dict[str, DataFrame], reporting: bool = True) -> None:
    """Register frames as session views; with ``reporting``, views with personal columns are refused and taken back."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    if reporting and (found := [x for x in personal_views(spark) if x[0] in frames]):
        for name in {x[0] for x in found}:
            spark.catalog.dropTempView(name)
        raise ValueError(f"personal columns in views: {found}")


# What each view declares of its rows: unique key, columns without nulls, conditions.
_SHARES = [f"{c}_share BETWEEN 0 AND 1" for c in ("positive", "neutral", "negative")]
_NET, _ADDS_UP = "net_sentiment BETWEEN -1 AND 1", "positive + neutral + negative = records"
DECLARED = {
    "v_events": (["id"], [], []),
    "v_sentiment_daily": (["event_date", "source", "event_tag"], [], ["positive + neutral + negative <= records", _SHARES[0], _SHARES[2], _NET]),
    "v_sentiment_by_event": (["event_tag"], ["event_tag"], ["positive + neutral + negative <= records", _SHARES[0], _NET, "first_record_utc <= last_record_utc"]),
    "v_sentiment_by_event_source": (["event_tag", "source"], ["source"], ["records > 0", _ADDS_UP, "distinct_authors <= records", *_SHARES, _NET]),
    "v_sentiment_by_period": (
        ["grain", "period", "source"], ["grain", "period", "source", "records", "distinct_authors"],
        ["grain IN ('day', 'week', 'month')", "grain <> 'week' OR dayofweek(period) = 2", "grain <> 'month' OR day(period) = 1", _ADDS_UP,
         "distinct_authors <= records", "(records = 0) = (net_sentiment IS NULL)", *_SHARES, _NET],
    ),
    "v_source_coverage": (["source", "language"], [], [_ADDS_UP, _SHARES[0], "first_record_utc <= last_record_utc"]),
    "v_source_divergence": (["event_tag"], ["high_source", "high_net", "low_source", "low_net", "gap"], ["sources >= 2", "high_source <> low_source", "gap BETWEEN 0 AND 2"]),
    "v_event_lift": (
        ["event_tag", "source"], ["event_tag", "source", "records", "days", "net_sentiment", "per_day"],
        [f"event_tag <> '{BACKGROUND}'", "records > 0", "days > 0", "(baseline_records = 0) = (baseline_net_sentiment IS NULL)", _NET,
         "baseline_net_sentiment BETWEEN -1 AND 1", "net_lift BETWEEN -2 AND 2", "volume_multiplier > 0"],
    ),
}


def view_assertions(frames: dict[str, DataFrame]) -> DataFrame:
    """(view_name, check_name, violations) of every declared check that a view's rows break, and of personal columns."""
    found = []
    for name, df in frames.items():
        key, solid, conditions = DECLARED[name]
        broken = [F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(f"b{i}") for i, c in enumerate(conditions)]
        holes = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(solid)]
        texts = [*conditions, *[f"{c} is null" for c in solid], *[f"personal column {c}" for _, c in no_personal_columns({name: df})]]
        named = [f"b{i}" for i in range(len(conditions))] + [f"n{i}" for i in range(len(solid))]
        counts = [F.col(c) for c in named] + [F.lit(1).cast("long")] * (len(texts) - len(named))
        if texts:
            sums = df.agg(F.count(F.lit(1)).alias("all"), *broken, *holes)
            found.append(sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("view_name"), F.lit(t).alias("check_name"), c.alias("violations")) for t, c in zip(texts, counts, strict=True)]))))
        found.append(unique_key(df, *key).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("view_name"), F.lit("unique " + ", ".join(key)).alias("check_name"), "violations"))
    return reduce(DataFrame.unionByName, found).where("violations > 0")


def records_reconcile(events: DataFrame) -> DataFrame:
    """(check_name, records, expected) of every view whose records do not add up to the events."""
    total = events.agg(F.count(F.lit(1)).alias("expected"))
    daily, by_source = views.v_sentiment_daily(events), views.v_sentiment_by_event_source(events)
    sums = [
        daily.agg(F.lit("daily").alias("check_name"), F.sum("records").alias("records")),
        by_source.agg(F.lit("by_event_source").alias("check_name"), F.sum("records").alias("records")),
        views.v_source_coverage(events).agg(F.lit("coverage").alias("check_name"), F.sum("records").alias("records")),
        views.v_sentiment_by_period(events).groupBy(F.concat(F.lit("period_"), "grain").alias("check_name")).agg(F.sum("records").alias("records")),
    ]
    whole = reduce(DataFrame.unionByName, sums).crossJoin(total)
    per_source = events.groupBy("source").agg(F.count(F.lit(1)).alias("expected"))
    lift = views.v_event_lift(events).select(
        F.concat(F.lit("lift_"), "event_tag", F.lit("_"), "source").alias("check_name"), (F.col("records") + F.col("baseline_records")).alias("records"), "source"
    ).join(per_source, "source").drop("source")
    return whole.unionByName(lift).where("records <> expected")


def collection_quality(raw: DataFrame) -> DataFrame:
    """One row per source: duplicates, odd hashes, missing collection times, mean length, verdicts."""
    return raw.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("duplicate_ids"),
        F.count_if(F.length("author_hash") != 16).alias("odd_hashes"), F.count_if(F.col("collected_at").isNull()).alias("no_collected_at"),
        F.count_if(F.col("created_utc") > F.col("collected_at")).alias("future_timestamps"),
        F.avg(F.length("text")).alias("mean_length"), F.count_if(F.col("voted_up").isNotNull()).alias("with_verdict"),
    )
