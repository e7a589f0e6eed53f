"""Aggregates over sentiment labels; shares are ratios of counts, never averages of shares."""

from pyspark.sql import Column
from pyspark.sql import functions as F

def records() -> Column:
    return F.count(F.lit(1))


def count_of(label: str) -> Column:
    return F.count_if(F.col("sentiment_label") == label)


def share(label: str) -> Column:
    return F.try_divide(count_of(label), records())


def counts() -> list[Column]:
    return [records().alias("records"), count_of("pos").alias("positive"), count_of("neu").alias("neutral"), count_of("neg").alias("negative")]


def net() -> Column:
    return F.try_divide(count_of("pos") - count_of("neg"), records()).alias("net_sentiment")


def polarity() -> Column:
    label = F.col("sentiment_label")
    return F.when(label == "pos", 1.0).when(label == "neu", 0.0).when(label == "neg", -1.0)
