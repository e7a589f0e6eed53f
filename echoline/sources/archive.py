"""The raw archive: gzipped JSON lines under source/event/YYYY/MM/DD/HH; label tables; external baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW, RAW_COLUMNS


def archive_path(source: Column, event: Column, written: Column, batch: Column) -> Column:
    """The path of a batch, by UTC write time."""
    return F.concat_ws("/", source, event, F.date_format(written, "yyyy/MM/dd/HH"), F.concat(batch, F.lit(".jsonl.gz")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.jsonl.gz`` below ``path`` under the fixed schema; malformed lines fail the read."""
    return spark.read.schema(RAW).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*.gz").json(path)


def write_archive(raw: DataFrame, path: str, written: str, batch: str) -> list[str]:
    """Write a batch as gzipped JSON lines, a folder for each source and event under the UTC hour of writing; its places.

    The layout is that of ``archive_path``, the batch's name being a folder of part files.  An empty batch writes
    nothing but still names its place.
    """
    hour = written[:13].replace("-", "/").replace(" ", "/").replace("T", "/")
    kinds = [(r[0], r[1]) for r in raw.select("source", "event_tag").distinct().collect()]  # one row for each source and event
    places = [f"{path}/{source}/{event}/{hour}/{batch}" for source, event in kinds]
    for (source, event), place in zip(kinds, places, strict=True):
        rows = raw.where(F.col("source").eqNullSafe(source) & F.col("event_tag").eqNullSafe(event)).select(*RAW_COLUMNS)
        rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(place, compression="gzip")
    return places or [f"{path}/{hour}/{batch}"]


def load_landing(raw: DataFrame, path: str) -> int:
    """Truncate and load; the number of rows."""
    raw.select(*RAW_COLUMNS).write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path).count()  # from the files' footers


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gold, predictions or chunks as JSON lines with the position of each line's object in ``position``."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("position", F.monotonically_increasing_id())


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label table from JSON lines or CSV: lower-case names, string values; id and label are required."""
    df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.json(path)
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(c.lower()) for c in df.columns])
    lacking = {"id", "label"} - set(df.columns)
    if lacking:
        raise ValueError(f"{path} lacks {sorted(lacking)}")
    return df


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).withColumn("date_utc", F.to_date("date_utc"))


def load_calendar(spark: SparkSession, document: dict | list[dict]) -> DataFrame:
    """The lifecycle calendar from its parsed file ({events: [...]}) or list; a missing list and repeated ids are errors."""
    rows = document.get("events") if isinstance(document, dict) else document
    if not isinstance(rows, list) or not rows:
        raise ValueError("the calendar needs a top-level list of events")
    ids = [str(r["id"]) for r in rows]
    if len(set(ids)) != len(ids):
        raise ValueError("the calendar's events need distinct ids")
    keys = ("id", "name", "type", "date_utc")
    return spark.createDataFrame([tuple(str(r.get(k, "")) for k in keys) for r in rows], "id string, name string, type string, date_utc string").withColumn("date_utc", F.to_date("date_utc"))


# --- mappers of collected items ---------------------------------------------------------------------------------


def steam_records(reviews: DataFrame, appid: str, tag: str, salt: str) -> DataFrame:
    """Review structs to raw records; a missing verdict counts as a down-vote, as the collector defines it."""
    from ..functions.text import author_hash

    user = F.coalesce(F.nullif(F.col("author.steamid").cast("string"), F.lit("")), F.lit("[unknown]"))
    return reviews.select(
        F.concat(F.lit("steam:"), F.col("recommendationid").cast("string")).alias("id"), F.lit("steam").alias("source"), F.lit(None).cast("string").alias("parent_id"),
        F.timestamp_seconds("timestamp_created").alias("created_utc"), F.current_timestamp().alias("collected_at"), author_hash(user, salt).alias("author_hash"),
        F.coalesce("review", F.lit("")).alias("text"), F.col("language"), F.coalesce("votes_up", F.lit(0)).cast("long").alias("score"),
        F.lit(appid).alias("context_id"), F.lit(tag).alias("event_tag"), F.coalesce("voted_up", F.lit(False)).alias("voted_up"),
    )
