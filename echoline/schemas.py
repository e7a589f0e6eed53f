"""The fixed schemas, declared once; every other column list is derived from these."""

from pyspark.sql import types as T

LABELS = ("pos", "neu", "neg")
BACKGROUND = "general"


def _struct(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


RAW = _struct(
    ("id", T.StringType(), False), ("source", T.StringType(), False), ("parent_id", T.StringType(), True),
    ("created_utc", T.TimestampType(), False), ("collected_at", T.TimestampType(), True), ("author_hash", T.StringType(), True),
    ("text", T.StringType(), True), ("language", T.StringType(), True), ("score", T.LongType(), True),
    ("context_id", T.StringType(), True), ("event_tag", T.StringType(), True), ("voted_up", T.BooleanType(), True),
)
EVENTS = T.StructType(RAW.fields + _struct(
    ("sentiment_label", T.StringType(), True), ("sentiment_score", T.DoubleType(), True),
    ("model_version", T.StringType(), True), ("processed_at", T.TimestampType(), True),
).fields)
MESSAGE = _struct(("data", T.BinaryType(), True), ("attributes", T.MapType(T.StringType(), T.StringType()), True))
RAW_COLUMNS, EVENT_COLUMNS = RAW.fieldNames(), EVENTS.fieldNames()
PERSONAL = ("author_hash", "text")
