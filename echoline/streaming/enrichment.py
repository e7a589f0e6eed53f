"""Messages to enriched events: parse, validate, dead-letter, classify; one pure function for batch and stream."""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ALIASES, DENSE_CHARS, STUB_VERSION, WIDE_CHARS, detect_language, normalise, sound, stub_sentiment
from ..operators.merge import coverage, merge_latest
from ..operators.stored import StoredTable
from ..schemas import EVENT_COLUMNS, EVENTS
from .event_time import drop_repeats, read_messages
from .sinks import stream_id, write_once
from .watch import INBOX, Watch
from .workers import once

Classifier = Callable[[Column], Column]
Detector = Callable[[Column], Column]

#: Classifiers by name; each maps a text Column to struct(label, score) and is named with its version.
REGISTRY: dict[str, tuple[Classifier, str]] = {"stub": (stub_sentiment, STUB_VERSION)}


def load_classifier(name: str) -> tuple[Classifier, str]:
    """An unknown name fails here, on the driver, before any query starts."""
    if name not in REGISTRY:
        raise KeyError(f"no classifier {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def too_long(error: BaseException) -> bool:
    """Whether a model refused an input for its length."""
    return "expanded size of the tensor" in str(error) or "sequence length" in str(error)


def retryable(error: BaseException) -> bool:
    code = getattr(error, "code", None)
    return code == 429 or isinstance(code, int) and 500 <= code < 600


def parse_prediction(raw) -> tuple[str, float]:
    """(label, score) of one answer: a label, {label, score}, a list of these, or three scores (neg, neu, pos).

    Anything else is an error, never a neutral result.
    """
    if isinstance(raw, str):
        label = ALIASES.get(raw.strip().lower())
        if label is None:
            raise ValueError(f"unknown label {raw!r}")
        return label, 1.0
    if isinstance(raw, dict):
        name = next((raw[k] for k in ("label", "sentiment") if raw.get(k) is not None), None)
        if name is not None:
            score = next((raw[k] for k in ("score", "confidence", "probability") if raw.get(k) is not None), 1.0)
            if not 0.0 <= float(score) <= 1.0:
                raise ValueError(f"score outside 0..1: {score}")
            return parse_prediction(str(name))[0], float(score)
        raw = raw.get("scores")
    if isinstance(raw, (list, tuple)) and raw:
        if all(isinstance(x, dict) for x in raw):
            return max((parse_prediction(x) for x in raw), key=lambda x: x[1])
        if all(isinstance(x, (int, float)) for x in raw):
            if len(raw) != 3:
                raise ValueError(f"expected 3 class scores, got {len(raw)}")
            top = max(raw)
            share = [math.exp(x - top) for x in raw]
            return ("neg", "neu", "pos")[list(raw).index(top)], 1.0 / sum(share)
    raise ValueError(f"unsupported answer {raw!r}")


def ask(predict: Callable[[list[str]], list], texts: list[str], *, attempts: int = 5, longest_wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> list[tuple[str, float]]:
    """Answers in the texts' order; overload is retried with doubling waits, refused lengths with half the budget.

    What does not help is raised, so the task fails and is run again.
    """
    from ..functions.text import CUTS, LEAST_TOKENS, MAX_CHARS, MAX_TOKENS

    budget = MAX_TOKENS
    for cut in range(CUTS):
        sent = [shortened(t[:MAX_CHARS], budget) for t in texts]
        try:
            for attempt in range(attempts):
                try:
                    answers = predict(sent)
                    break
                except Exception as error:
                    if attempt + 1 == attempts or not retryable(error):
                        raise
                    sleep(min(longest_wait, float(1 << attempt)))
        except Exception as error:
            if cut + 1 == CUTS or not too_long(error):
                raise
            budget = max(LEAST_TOKENS, budget / 2)
            continue
        if len(answers) != len(texts):
            raise ValueError("the classifier answered another number of texts")
        return [parse_prediction(x) for x in answers]
    raise AssertionError("unreachable")


def shortened(text: str, budget: float) -> str:
    """As ``fit_to_tokens``, for the worker's Python."""
    wide, dense = re.compile(WIDE_CHARS), re.compile(DENSE_CHARS)
    spent = 0.0
    if len(wide.findall(text)) + len(dense.findall(text)) / 2 + (len(text) - len(wide.findall(text)) - len(dense.findall(text))) / 4 <= budget:
        return text
    for i, c in enumerate(text):
        spent += 1.0 if wide.match(c) else 0.5 if dense.match(c) else 0.25
        if spent >= budget:
            return text[:i]
    return text


def pandas_classifier(setup: Callable[[], Callable[[list[str]], list]], batch: int = 200) -> Classifier:
    """A classifier from a remote or heavy model: ``setup`` runs once a worker process and gives the function that is asked.

    Blank texts are not sent and get ('neu', 0.0); texts are normalised and sent in batches of 1 to ``batch``.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("label string, score double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = once(name, setup)
        for texts in series:
            bodies = texts.fillna("")
            sent = bodies[bodies.str.strip() != ""]
            out = pd.DataFrame({"label": "neu", "score": 0.0}, index=bodies.index)
            for at in range(0, len(sent), batch):
                part = sent.iloc[at : at + batch]
                out.loc[part.index, ["label", "score"]] = pd.DataFrame(ask(predict, part.tolist()), index=part.index, columns=["label", "score"])
            yield out

    return lambda text: run(normalise(text))


#: Fields of a message; a value of any type is taken as it comes and judged by its kind.
FIELDS = ("id", "source", "parent_id", "created_utc", "collected_at", "author_hash", "text", "language", "score", "context_id", "event_tag", "voted_up")
STRINGS = ("id", "source", "parent_id", "author_hash", "text", "language", "context_id", "event_tag")
#: What an ISO timestamp may look like: dashed, basic, or by weeks, with an optional time and offset.
DAY, CLOCK = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(?:-?[1-7])?)", r"(\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?)"
ISO = rf"^{DAY}(?:[T ]{CLOCK}(Z|[+-]\d{{2}}(?::?\d{{2}})?)?)?$"


def iso_time(text: Column) -> Column:
    """The timestamp of an ISO 8601 string (naive ones are UTC); null for anything else."""
    part = lambda i: F.regexp_extract(text, ISO, i)
    day = F.translate(part(1), "-", "")
    week = F.concat_ws("-", F.substring(day, 1, 4), F.lit("01"), F.lit("04"))  # the fourth of January is in the first week
    monday = F.date_add(F.trunc(F.try_to_date(week), "WEEK"), (F.try_element_at(F.split(day, "W"), F.lit(2)).substr(1, 2).cast("int") - 1) * 7)
    weekday = F.coalesce(F.nullif(F.substring(day, 8, 1), F.lit("")).cast("int"), F.lit(1))
    date = F.when(day.contains("W"), F.date_format(F.date_add(monday, weekday - 1), "yyyy-MM-dd")).otherwise(F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
    clock = F.translate(F.translate(part(2), ":", ""), ",", ".")
    time_ = F.concat_ws(":", F.substring(F.rpad(F.substring(clock, 1, 6), 6, "0"), 1, 2), F.substring(F.rpad(F.substring(clock, 1, 6), 6, "0"), 3, 2), F.substring(F.rpad(F.substring(clock, 1, 6), 6, "0"), 5, 2))
    zone = F.translate(part(3), ":", "")
    offset = F.when((zone == "") | (zone == "Z"), "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.rpad(F.substring(zone, 4, 2), 2, "0")))
    return F.when(text.rlike(ISO), F.try_to_timestamp(F.concat(date, F.lit(" "), time_, F.substring(clock, 7, 10), offset)))


def _bound(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A projection that later ones and filters are not merged with, so that its columns are computed once."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def parse(messages: DataFrame) -> DataFrame:
    """Add to (data, attributes) the raw fields and ``error``, null where the message is valid.

    The JSON is read once into a struct of variants; each step is bound before the next one uses it, so nothing is read
    twice.
    """
    shape = ", ".join(f"{c}: variant" for c in FIELDS)
    step = messages.withColumn("_body", F.try_validate_utf8(F.col("data").cast("string"))).withColumn("_v", F.try_parse_json("_body"))
    step = _bound(step, "data", "attributes", "_body", "_v", F.expr(f"try_variant_get(_v, '$', 'struct<{shape}>')").alias("_r"))
    kind = lambda c: F.expr(f"schema_of_variant(_r.{c})")
    as_text = lambda c: F.expr(f"try_variant_get(_r.{c}, '$', 'string')")
    step = _bound(
        step, "data", "attributes", "_body", F.col("_v").isNotNull().alias("_json"), F.col("_r").isNotNull().alias("_object"),
        *[as_text(c).alias(f"_{c}") for c in FIELDS], *[kind(c).alias(f"_k_{c}") for c in ("created_utc", "collected_at", "score", "voted_up", *STRINGS)],
        F.expr("try_variant_get(_r.score, '$', 'bigint')").alias("_number"), F.expr("try_variant_get(_r.voted_up, '$', 'double')").alias("_vote"),
    )
    is_text = lambda c: F.col(f"_k_{c}") == "STRING"
    step = step.withColumns({"_created": F.when(is_text("created_utc"), iso_time(F.col("_created_utc"))), "_collected": F.when(is_text("collected_at"), iso_time(F.col("_collected_at")))})
    error = (
        F.when(F.col("_body").isNull(), "payload is not UTF-8")
        .when(~F.col("_json"), "payload is not JSON")
        .when(~F.col("_object"), "payload is not an object")
        .when(F.coalesce("_id", F.lit("")) == "", "id is missing")
        .when(F.coalesce("_created_utc", F.lit("")) == "", "created_utc is missing")
        .when(F.col("_created").isNull(), "created_utc is not a timestamp")
        .when(is_text("collected_at") & (F.col("_collected_at") != "") & F.col("_collected").isNull(), "collected_at is not a timestamp")
    )
    # truth as the contract has it: any non-empty text, number but zero, list or object with something in it
    vote = F.when(F.col("_k_voted_up") == "BOOLEAN", F.col("_voted_up") == "true").when(F.col("_k_voted_up") == "STRING", F.col("_voted_up") != "")
    vote = vote.when(F.col("_k_voted_up").isin("VOID"), None).when(F.col("_k_voted_up").startswith("ARRAY") | F.col("_k_voted_up").startswith("OBJECT"), ~F.col("_voted_up").isin("[]", "{}"))
    vote = F.when(F.col("_voted_up").isNull(), None).otherwise(vote.otherwise(F.col("_vote") != 0))
    text = lambda c: F.when(F.col(f"_k_{c}") == "BOOLEAN", F.initcap(f"_{c}")).otherwise(F.col(f"_{c}")).alias(c)
    given = {
        "created_utc": F.col("_created"), "collected_at": F.col("_collected"), "voted_up": vote,
        "score": F.when(F.col("_k_score") != "BOOLEAN", F.col("_number")),
    }
    return _bound(step, "data", "attributes", error.alias("error"), *[text(c) for c in STRINGS], *[v.alias(k) for k, v in given.items()])


def dead_letters(parsed: DataFrame, at: str) -> DataFrame:
    """The original payloads with the error (at most 1024 characters) among the attributes."""
    extra = F.create_map(F.lit("dlq_error"), F.substring("error", 1, 1024), F.lit("dlq_at"), F.lit(at))
    none = F.expr("map()").cast("map<string,string>")
    return parsed.where("error IS NOT NULL").select("data", F.map_concat(F.coalesce("attributes", none), extra).alias("attributes"))


def enrich(parsed: DataFrame, processed_at: str, classifier: str = "stub", detect: Detector = detect_language) -> DataFrame:
    """Valid rows with the events table's columns; the language that ``detect`` finds replaces the declared one."""
    classify, version = load_classifier(classifier)
    rows = parsed.where("error IS NULL").withColumn("_s", classify(F.col("text"))).withColumn("_s", sound(F.col("_s")))
    return rows.select(
        *[F.col(c) for c in EVENT_COLUMNS[:7]], detect(F.col("text")).alias("language"), *[F.col(c) for c in EVENT_COLUMNS[8:12]],
        F.col("_s.label").alias("sentiment_label"), F.col("_s.score").alias("sentiment_score"), F.lit(version).alias("model_version"),
        F.lit(processed_at).cast("timestamp").alias("processed_at"),
    )


#: Columns that the table requires, and the widest text that it takes.
REQUIRED, WIDEST = ("id", "source", "created_utc"), 10 << 20


def refused(rows: DataFrame) -> Column:
    """Why the table would refuse a row; null where it takes it."""
    holes = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    years = F.year("created_utc")
    return F.when(holes != "", F.concat(F.lit("required and null: "), holes)).when((years < 1) | (years > 9999), "created_utc out of range").when(F.octet_length("text") > WIDEST, "text too wide")


def rejected_rows(rows: DataFrame, at: str) -> DataFrame:
    """Rows that the table refuses, as dead letters: the row as JSON, with the reason."""
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    extra = F.create_map(F.lit("dlq_error"), F.substring(F.concat(F.lit("rejected by the table: "), refused(rows)), 1, 1024), F.lit("dlq_at"), F.lit(at))
    return rows.where(refused(rows).isNotNull()).select(F.encode(body, "UTF-8").alias("data"), extra.alias("attributes"))


def create_table(spark: SparkSession, path: str) -> None:
    """An empty events table; appending never creates one."""
    spark.createDataFrame([], EVENTS).write.mode("errorifexists").parquet(path)


def fits(rows: DataFrame, path: str) -> None:
    """Raise unless there is a table that has the rows' names and types."""
    try:
        there = rows.sparkSession.read.parquet(path).schema
    except AnalysisException as error:
        raise RuntimeError(f"{path} is no table; create it first") from error
    own = [(f.name, f.dataType.simpleString()) for f in rows.schema]
    if own != [(f.name, f.dataType.simpleString()) for f in there]:
        raise RuntimeError(f"{path} has other columns than the rows")


def append(rows: DataFrame, path: str) -> None:
    """Append to a table that exists and has the rows' names and types."""
    fits(rows, path)
    rows.write.mode("append").parquet(path)


def run_stream(
    spark: SparkSession, inbox: str, landing: str, dlq: str, checkpoint: str, processed_at: str, classifier: str = "stub",
    repeats_within: str | None = None, watch: Watch | None = None, files_per_batch: int | None = None, detect: Detector = detect_language,
) -> None:
    """Drain a folder of JSON messages (data as base64) into landing and dead letters, each micro-batch once.

    The landing table must exist.  Payloads that do not parse and rows that the table refuses become dead letters.
    A run that died anywhere is repeated from its checkpoint: what a batch had written is kept, the rest is added.
    ``detect`` is the language detector, such as one of fitted profiles (``functions/languages.py``).
    With ``repeats_within``, messages of an id that came before are dropped while the watermark allows.
    """
    load_classifier(classifier)
    source = read_messages(spark, inbox, files_per_batch).observe(INBOX, F.min("arrived").alias("oldest"))
    source = drop_repeats(source, repeats_within) if repeats_within else source

    def write(batch: DataFrame, number: int) -> None:
        stream = stream_id(spark, checkpoint)
        parsed = parse(batch.select("data", "attributes")).persist()
        try:
            rows, told = enrich(parsed, processed_at, classifier, detect), Observation()
            taken = rows.where(refused(rows).isNull())
            fits(taken, landing)
            write_once(taken, landing, stream, number)
            letters = dead_letters(parsed, processed_at).unionByName(rejected_rows(rows, processed_at))
            if write_once(letters.observe(told, F.count(F.lit(1)).alias("n")), dlq, stream, number) and watch:
                watch.dead_letters(told.get.get("n", 0))
        finally:
            parsed.unpersist()

    if watch:
        spark.streams.addListener(watch)
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def daily_sentiment(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Extension: tumbling daily label counts of a stream or a table, late records up to ``late``."""
    return events.withWatermark("created_utc", late).groupBy(F.window("created_utc", "1 day").alias("day"), "source", "sentiment_label").agg(F.count(F.lit(1)).alias("records"))


def gate(staging: DataFrame, landing: DataFrame, run_start: str, event: str | None = None, before: int | None = None) -> DataFrame:
    """One row (staged, landed, missing, complete): whether all staged ids have landed since the run began.

    A run for one event counts only that event's ids; where what it published is not known (``before``, the count some
    minutes ago), it is complete when the count is above zero and no longer changes.
    """
    since = landing.where(F.col("processed_at") >= F.lit(run_start).cast("timestamp"))
    if event is not None:
        staging, since = staging.where(F.col("event_tag") == event), since.where(F.col("event_tag") == event)
    row = coverage(staging, since)
    done = (F.col("landed") > 0) & (F.col("landed") == before) if before is not None else F.col("missing_exact") == 0
    return row.select("staged", "landed", F.col("missing_exact").alias("missing"), done.alias("complete"))


def alerts(messages: DataFrame, dead: DataFrame, now: str, started: str, failed: bool = False, longest_s: int = 5400, backlog_s: int = 600) -> DataFrame:
    """(alert, value) of what needs a person: a failed or too long run, old unread messages, any dead letter."""
    at = F.lit(now).cast("timestamp")
    age = lambda c: F.unix_seconds(at) - F.unix_seconds(c)
    oldest = messages.agg(F.coalesce(F.max(age(F.try_to_timestamp(F.col("attributes")["created_utc"]))), F.lit(0)).alias("value"))
    letters = dead.agg(F.count(F.lit(1)).alias("value"))
    run = messages.sparkSession.range(1).select(F.lit(1 if failed else 0).cast("long").alias("failed"), age(F.lit(started).cast("timestamp")).alias("took"))
    rows = [
        run.select(F.lit("job failed").alias("alert"), F.col("failed").alias("value"), F.lit(0).alias("bound")),
        run.select(F.lit("run too long").alias("alert"), F.col("took").alias("value"), F.lit(longest_s).alias("bound")),
        oldest.select(F.lit("backlog too old").alias("alert"), "value", F.lit(backlog_s).alias("bound")),
        letters.select(F.lit("dead letters").alias("alert"), "value", F.lit(0).alias("bound")),
    ]
    return reduce(DataFrame.unionByName, rows).where("value > bound").select("alert", F.col("value").cast("long").alias("value"))


def promote(events: DataFrame, landing: DataFrame, staging: DataFrame, run_start: str | None = None) -> DataFrame:
    """The events table after the merge; refuses while staged records are missing from the landing table."""
    since = landing if run_start is None else landing.where(F.col("processed_at") >= F.lit(run_start).cast("timestamp"))
    missing = coverage(staging, since).first()["missing_exact"]
    if missing:
        raise RuntimeError(f"{missing} staged records have not landed")
    return merge_latest(events, landing, "processed_at")


def drain_and_promote(
    spark: SparkSession, inbox: str, landing: str, dlq: str, checkpoint: str, staging: DataFrame, table: StoredTable,
    processed_at: str, run_start: str, event: str | None = None, classifier: str = "stub", watch: Watch | None = None, detect: Detector = detect_language,
) -> StoredTable:
    """Drain the inbox, then merge what has landed since the run began into the stored table, if all of it has.

    While staged records are missing, nothing is merged and this raises; a repeated run drains what is new, adds no row
    twice, and merges rows that the table has already without changing it.
    """
    run_stream(spark, inbox, landing, dlq, checkpoint, processed_at, classifier, watch=watch, detect=detect)
    landed = spark.read.schema(EVENTS).parquet(landing)
    state = gate(staging, landed, run_start, event).first()
    if not state.complete:
        raise RuntimeError(f"{state.missing} of {state.staged} staged records have not landed")
    since = landed.where(F.col("processed_at") >= F.lit(run_start).cast("timestamp"))
    return table.merge(since if event is None else since.where(F.col("event_tag") == event), "processed_at")
