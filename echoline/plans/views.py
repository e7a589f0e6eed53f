"""The reporting views, as functions of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sentiment as S
from ..schemas import BACKGROUND



def _authors():
    return F.countDistinct("author_hash").alias("distinct_authors")


def _confidence():
    return F.avg("sentiment_score").alias("avg_confidence")


def _shares(*labels: str) -> list:
    return [S.share(x).alias({"pos": "positive", "neu": "neutral", "neg": "negative"}[x] + "_share") for x in labels]


def v_events(events: DataFrame) -> DataFrame:
    return events.select(
        "id", "source", "created_utc", F.to_date("created_utc").alias("event_date"), "event_tag", "language", "score", "voted_up",
        "sentiment_label", "sentiment_score", "model_version",
    )


def v_sentiment_daily(events: DataFrame) -> DataFrame:
    by = events.groupBy(F.to_date("created_utc").alias("event_date"), "source", "event_tag")
    return by.agg(*S.counts(), *_shares("pos", "neg"), S.net(), _confidence(), _authors())


def v_sentiment_by_event(events: DataFrame) -> DataFrame:
    return events.where("event_tag IS NOT NULL").groupBy("event_tag").agg(
        F.min("created_utc").alias("first_record_utc"), F.max("created_utc").alias("last_record_utc"), *S.counts(),
        F.countDistinct("source").alias("sources"), _authors(), *_shares("pos"), S.net(),
    )


def v_sentiment_by_event_source(events: DataFrame) -> DataFrame:
    return events.groupBy("event_tag", "source").agg(*S.counts(), *_shares("pos", "neu", "neg"), S.net(), _confidence(), _authors())


def v_source_coverage(events: DataFrame) -> DataFrame:
    return events.groupBy("source", "language").agg(
        *S.counts(), F.min("created_utc").alias("first_record_utc"), F.max("created_utc").alias("last_record_utc"),
        F.countDistinct("event_tag").alias("event_tags"), *_shares("pos"),
    )


def _period(day, grain):
    return F.when(grain == "day", day).when(grain == "week", F.trunc(day, "WEEK")).otherwise(F.trunc(day, "MONTH"))


def _grains():
    return F.explode(F.array(F.lit("day"), F.lit("week"), F.lit("month")))


def v_sentiment_by_period(events: DataFrame) -> DataFrame:
    """Counts at three grains in one aggregation, on a dense spine of periods and sources.

    Each record is multiplied by the grains in place (no join with a calendar), so distinct authors stay exact.
    """
    rows = events.select("source", "sentiment_label", "sentiment_score", "author_hash", F.to_date("created_utc").alias("day"), _grains().alias("grain"))
    rows = rows.withColumn("period", _period(F.col("day"), F.col("grain")))
    counted = rows.groupBy("grain", "period", "source").agg(*S.counts(), *_shares("pos", "neu", "neg"), S.net(), _confidence(), _authors())
    bounds = events.agg(F.min(F.to_date("created_utc")).alias("a"), F.max(F.to_date("created_utc")).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("day")).select("day", _grains().alias("grain"))
    periods = days.select("grain", _period(F.col("day"), F.col("grain")).alias("period")).distinct()
    spine = periods.crossJoin(events.select("source").distinct())
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(counted, ["grain", "period", "source"], "left").select(
        "grain", "period", "source", zero("records"), zero("positive"), zero("neutral"), zero("negative"), "positive_share",
        "neutral_share", "negative_share", "net_sentiment", "avg_confidence", zero("distinct_authors"),
    )


def v_source_divergence(events: DataFrame) -> DataFrame:
    """Highest and lowest net source of tags with several; equal nets are told apart by source."""
    pair = F.struct("net_sentiment", "source")
    ranked = v_sentiment_by_event_source(events).groupBy("event_tag").agg(F.count(F.lit(1)).alias("sources"), F.max(pair).alias("high"), F.min(pair).alias("low"))
    return ranked.where("sources >= 2").select(
        "event_tag", "sources", F.col("high.source").alias("high_source"), F.col("high.net_sentiment").alias("high_net"),
        F.col("low.source").alias("low_source"), F.col("low.net_sentiment").alias("low_net"),
        (F.col("high.net_sentiment") - F.col("low.net_sentiment")).alias("gap"),
    )


def v_event_lift(events: DataFrame) -> DataFrame:
    """Each event's records against all other records of its source.

    The others are the source's totals less the event's own.  Their days are the source's days less those on which
    nothing but the event was seen.
    """
    facts = events.select("source", "event_tag", "sentiment_label", F.to_date("created_utc").alias("day"))
    cells = facts.groupBy("source", "day", "event_tag").agg(S.records().alias("n"), (S.count_of("pos") - S.count_of("neg")).alias("balance"))
    per_day = cells.groupBy("source", "day").agg(F.count(F.lit(1)).alias("tags"), F.first("event_tag").alias("only_tag"), F.sum("n").alias("n"), F.sum("balance").alias("balance"))
    whole = per_day.groupBy("source").agg(F.sum("n").alias("all_n"), F.sum("balance").alias("all_balance"), F.count(F.lit(1)).alias("all_days"))
    alone = per_day.where("tags = 1").groupBy("source", F.col("only_tag").alias("event_tag")).agg(F.count(F.lit(1)).alias("alone_days"))
    own = cells.where(F.col("event_tag") != BACKGROUND).groupBy("event_tag", "source").agg(F.sum("n").alias("records"), F.sum("balance").alias("balance"), F.count(F.lit(1)).alias("days"))
    met = own.join(whole, "source").join(alone, ["event_tag", "source"], "left")
    rest, days = F.col("all_n") - F.col("records"), F.col("all_days") - F.coalesce("alone_days", F.lit(0))
    net, base = F.try_divide("balance", "records"), F.try_divide(F.col("all_balance") - F.col("balance"), rest)
    pace, usual = F.try_divide("records", "days"), F.try_divide(rest, days)
    return met.select(
        "event_tag", "source", "records", "days", net.alias("net_sentiment"), pace.alias("per_day"), rest.alias("baseline_records"), days.alias("baseline_days"),
        base.alias("baseline_net_sentiment"), usual.alias("baseline_per_day"), (net - base).alias("net_lift"), F.try_divide(pace, usual).alias("volume_multiplier"),
    )


def time_windows(events: DataFrame, launch: str) -> DataFrame:
    """Four overlapping half-open windows around a launch; a record lands in each that holds it, without a join."""
    t = F.lit(launch).cast("timestamp")
    spans = {"week_before": ("-7 days", "0 days"), "launch_day": ("0 days", "1 day"), "hours_48": ("0 days", "48 hours"), "week_after": ("0 days", "7 days")}
    at = lambda x: t + F.expr(f"INTERVAL {x}")
    inside = [F.when((F.col("created_utc") >= at(a)) & (F.col("created_utc") < at(b)), F.lit(k)) for k, (a, b) in spans.items()]
    rows = events.withColumn("window_id", F.explode(F.array_compact(F.array(*inside))))
    return rows.groupBy("window_id", "event_tag", "source").agg(
        S.records().alias("n"), S.count_of("pos").alias("n_pos"), S.count_of("neu").alias("n_neu"), S.count_of("neg").alias("n_neg"),
        S.share("pos").alias("share_pos"), S.share("neg").alias("share_neg"), F.avg("sentiment_score").alias("avg_score"),
        F.avg(S.polarity()).alias("mean_polarity"),
    )


def event_polarity(events: DataFrame) -> DataFrame:
    return events.groupBy("event_tag", "source").agg(
        S.records().alias("n"), S.share("pos").alias("share_pos"), S.share("neg").alias("share_neg"), F.avg(S.polarity()).alias("mean_polarity")
    )


VIEWS = {
    "v_events": v_events, "v_sentiment_daily": v_sentiment_daily, "v_sentiment_by_event": v_sentiment_by_event,
    "v_sentiment_by_event_source": v_sentiment_by_event_source, "v_sentiment_by_period": v_sentiment_by_period,
    "v_source_coverage": v_source_coverage, "v_source_divergence": v_source_divergence, "v_event_lift": v_event_lift,
}


def dashboard_rollup(daily: DataFrame, *dims: str) -> DataFrame:
    """Scorecards over any subset: sums of additive counts and their ratios."""
    total = lambda c: F.sum(c)
    return daily.groupBy(*dims).agg(
        total("records").alias("records"), total("positive").alias("positive"), total("negative").alias("negative"),
        F.try_divide(total("positive"), total("records")).alias("positive_share"),
        F.try_divide(total("positive") - total("negative"), total("records")).alias("net_sentiment"),
    )


def period_report(events: DataFrame, grain: str, least: int = 20) -> DataFrame:
    """What a report plots: one grain's periods with enough records, with the weekday and day of the month."""
    rows = v_sentiment_by_period(events).where((F.col("grain") == grain) & (F.col("records") >= least))
    return rows.select("period", "source", "records", "net_sentiment", F.dayofweek("period").alias("weekday"), F.dayofmonth("period").alias("day"))


def register(events: DataFrame) -> None:
    for name, view in VIEWS.items():
        view(events).createOrReplaceTempView(name)
