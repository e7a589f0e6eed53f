"""Paged sources as Spark data sources over saved pages, their record mappers, and an ordered publisher.

``review_walk`` reads one folder a partition of a walk (its pages as JSON files ``<cursor>.json``), follows the pages'
cursors and stops where the walk's rules say; as a stream it hands on whole pages, and Spark's checkpoint keeps the
cursor, so an interrupted walk goes on where its last written batch ended.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.text import author_hash
from ..operators import trees

REVIEW = "partition string, review string, timestamp_created long"
FIRST_CURSOR = "*"


def page_file(folder: str, cursor: str) -> str:
    return os.path.join(folder, f"{'first' if cursor == FIRST_CURSOR else cursor.encode().hex()}.json")


def fetch(folder: str, cursor: str) -> dict | None:
    """One saved page; None where there is none; a page that reports failure is an error."""
    path = page_file(folder, cursor)
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as file:
        page = json.load(file)
    if page.get("success") != 1:
        raise RuntimeError(f"{path} reports failure")
    return page


def walk(folder: str, cursor: str = FIRST_CURSOR, max_pages: int = 0, since: int | None = None, until: int | None = None, descending: bool = True) -> Iterator[tuple[str, list[dict]]]:
    """(next cursor, reviews in [since, until)) page by page.

    Ends at an empty page, a repeated or missing cursor, the page cap (0: none), or, in a walk from new to old, at the
    first review before the window; other orders skip what is outside.
    """
    seen, pages = {cursor}, 0
    while not max_pages or pages < max_pages:
        page = fetch(folder, cursor)
        if page is None or not page.get("reviews"):
            return
        pages += 1
        kept, past = [], False
        for review in page["reviews"]:
            at = int(review["timestamp_created"])
            if since is not None and at < since:
                if descending:
                    past = True
                    break
                continue
            if until is None or at < until:
                kept.append(review)
        following = page.get("cursor")
        yield str(following or ""), kept
        if past or not following or following in seen:
            return
        seen.add(following)
        cursor = following


def _options(options: dict) -> dict:
    number = lambda k: int(options[k]) if options.get(k) else None
    return {"max_pages": number("maxpages") or 0, "since": number("since"), "until": number("until"), "descending": options.get("filter", "recent") == "recent"}


class _Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ReviewReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Folder(p) for p in self.options["path"].split(",")]

    def read(self, partition):
        for _, reviews in walk(partition.path, **_options(self.options)):
            for r in reviews:
                yield os.path.basename(partition.path), json.dumps(r), int(r["timestamp_created"])


class ReviewStream(SimpleDataSourceStreamReader):
    """One folder's walk; an offset is the next page's cursor, of the window that it belongs to."""

    def __init__(self, options: dict):
        self.options = options
        self.window = f"{options.get('since', '')}..{options.get('until', '')}"

    def initialOffset(self):
        return {"cursor": FIRST_CURSOR, "window": self.window}

    def _from(self, start: dict) -> str:
        return start["cursor"] if start.get("window") == self.window else FIRST_CURSOR  # another window's cursor is of no use

    def read(self, start):
        rows, cursor, folder = [], self._from(start), self.options["path"]
        for pages, (following, reviews) in enumerate(walk(folder, cursor, **_options(self.options) | {"max_pages": int(self.options.get("pagesperbatch", 25))}), 1):
            rows += [(os.path.basename(folder), json.dumps(r), int(r["timestamp_created"])) for r in reviews]
            cursor = following or cursor
        return iter(rows), {"cursor": cursor, "window": self.window}

    def readBetweenOffsets(self, start, end):
        rows = []
        for following, reviews in walk(self.options["path"], self._from(start), **_options(self.options) | {"max_pages": 0}):
            rows += [(os.path.basename(self.options["path"]), json.dumps(r), int(r["timestamp_created"])) for r in reviews]
            if following == end["cursor"]:
                break
        return iter(rows)

    def commit(self, end):
        pass


class ReviewWalk(DataSource):
    """Options: path (folders, comma-separated), maxPages, since, until (epoch seconds), filter, pagesPerBatch."""

    @classmethod
    def name(cls):
        return "review_walk"

    def schema(self):
        return REVIEW

    def reader(self, schema):
        return ReviewReader(dict(self.options))

    def simpleStreamReader(self, schema):
        return ReviewStream(dict(self.options))


# --- records --------------------------------------------------------------------------------------------------------


def _or(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(value))


def record(id_: Column, source: str, user: Column, salt: str, text: Column, score: Column, context: Column, tag: str, created: Column, parent: Column, collected: Column) -> list[Column]:
    """The raw fields of one collected item; ``created`` is epoch seconds."""
    none = F.lit(None)
    return [
        F.concat(F.lit(f"{source}:"), id_).alias("id"), F.lit(source).alias("source"), parent.cast("string").alias("parent_id"),
        F.timestamp_seconds(F.floor(created)).alias("created_utc"), collected.alias("collected_at"), author_hash(user, salt).alias("author_hash"),
        text.alias("text"), none.cast("string").alias("language"), score.cast("long").alias("score"), context.cast("string").alias("context_id"),
        F.lit(tag).alias("event_tag"), none.cast("boolean").alias("voted_up"),
    ]


COMMENT = "struct<id: string, snippet: struct<authorDisplayName: string, textOriginal: string, textDisplay: string, likeCount: long, publishedAt: string>>"
THREADS = f"videoId string, items array<struct<snippet: struct<topLevelComment: {COMMENT}>, replies: struct<comments: array<{COMMENT}>>>>, nextPageToken string"


def read_threads(spark, path: str) -> DataFrame:
    """Saved pages of comment threads, one JSON object a file or a line."""
    return spark.read.schema(THREADS).option("multiLine", "true").json(path)


def youtube_comments(pages: DataFrame) -> DataFrame:
    """(videoId, c, parent_id) of threads and their nested replies; one pass, replies beside their thread's top comment."""
    thread = pages.select("videoId", F.explode("items").alias("i"))
    top = F.struct(F.col("i.snippet.topLevelComment").alias("c"), F.lit(None).cast("string").alias("parent_id"))
    replies = F.transform(F.coalesce("i.replies.comments", F.array().cast(f"array<{COMMENT}>")), lambda c: F.struct(c.alias("c"), F.col("i.snippet.topLevelComment.id").alias("parent_id")))
    return thread.select("videoId", F.inline(F.concat(F.array(top), replies)))


def youtube_records(comments: DataFrame, tag: str, salt: str, collected: Column, since: str | None = None, until: str | None = None) -> DataFrame:
    """Raw records of comments published in the half-open window."""
    s = lambda k: F.col(f"c.snippet.{k}")
    at = F.to_timestamp(s("publishedAt"))
    held = comments.where(at >= F.lit(since).cast("timestamp")) if since else comments
    held = held.where(at < F.lit(until).cast("timestamp")) if until else held
    text = F.coalesce(F.nullif(s("textOriginal"), F.lit("")), s("textDisplay"), F.lit(""))
    return held.select(*record(F.col("c.id"), "youtube", _or(s("authorDisplayName"), "[deleted]"), salt, text, F.coalesce(s("likeCount"), F.lit(0)), F.col("videoId"), tag, F.unix_seconds(at), F.col("parent_id"), collected))


def video_ids(videos: DataFrame, event: str) -> DataFrame:
    """Videos (id, event_ids) of an event, placeholders left out."""
    return videos.where(F.array_contains("event_ids", event) & ~F.col("id").startswith("REPLACE")).select("id")


def window_slices(windows: DataFrame, hours: int = 6) -> DataFrame:
    """(channel, slice_start, slice_end) that cover each half-open window (channel, start, end) in order, the last one cut short.

    A window that is empty, or lacks an end, has no slices.
    """
    step = F.expr(f"INTERVAL {hours} HOURS")
    at = F.filter(F.sequence("start", F.greatest("start", "end"), step), lambda t: t < F.col("end"))
    cut = windows.where("start < end").select("channel", "end", F.explode(at).alias("slice_start"))
    return cut.select("channel", "slice_start", F.least(F.col("slice_start") + step, F.col("end")).alias("slice_end"))


def search_requests(records: DataFrame, hours: int = 6) -> DataFrame:
    """One row for each channel and slice of a search that covers the records (source, created_utc) of each source."""
    ends = (F.max("created_utc") + F.expr("INTERVAL 1 SECOND")).alias("end")
    return window_slices(records.groupBy(F.col("source").alias("channel")).agg(F.min("created_utc").alias("start"), ends), hours)


NESTED = "struct<fullname: string, author: string, body: string, score: long, created_utc: double, parent_id: string, depth: int>"


def reddit_records(posts: DataFrame, tag: str, salt: str, collected: Column, depth: int = 2) -> DataFrame:
    """Raw records of posts and of their comments down to ``depth`` (0: top level).

    Posts: (fullname, author, title, selftext, score, subreddit, created_utc, comments); comments: (fullname, author,
    body, score, created_utc, parent_id, depth), already listed depth first.
    """
    name = lambda c: _or(c, "[deleted]")
    text = F.btrim(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("selftext", F.lit(""))), F.lit(" \t\r\n\x0b\x0c"))
    own = posts.select(*record(F.col("fullname"), "reddit", name(F.col("author")), salt, text, F.col("score"), F.col("subreddit"), tag, F.col("created_utc"), F.lit(None), collected))
    c = posts.select("subreddit", F.explode("comments").alias("c")).where(F.col("c.depth") <= depth)
    said = c.select(*record(F.col("c.fullname"), "reddit", name(F.col("c.author")), salt, F.coalesce("c.body", F.lit("")), F.col("c.score"), F.col("subreddit"), tag, F.col("c.created_utc"), F.col("c.parent_id"), collected))
    return own.unionByName(said)


def reddit_search(posts: DataFrame, comments: DataFrame, tag: str, salt: str, collected: Column, since: str | None = None, until: str | None = None, depth: int = 2) -> DataFrame:
    """Raw records of the posts created in the half-open window and of the comments below them, down to ``depth``.

    Both are flat rows: posts as for ``reddit_records`` without comments, comments (fullname, author, body, score,
    created_utc, parent_id) in any order.  A post that several searches found is one record.  Comments that no chain of
    at most ``depth`` parents ties to a post in the window are left out, circles among them; repeated comments stay.
    """
    at = F.timestamp_seconds("created_utc")
    held = posts.where(at >= F.lit(since).cast("timestamp")) if since else posts
    held = held.where(at < F.lit(until).cast("timestamp")) if until else held
    held = held.where("fullname IS NOT NULL").dropDuplicates(["fullname"])
    placed = trees.reply_depths(held, comments, depth, "fullname", "fullname", "parent_id")
    under = placed.join(held.select(F.col("fullname").alias("root"), "subreddit"), "root")
    said = under.select(*record(F.col("fullname"), "reddit", _or(F.col("author"), "[deleted]"), salt, F.coalesce("body", F.lit("")), F.col("score"), F.col("subreddit"), tag, F.col("created_utc"), F.col("parent_id"), collected))
    own = reddit_records(held.withColumn("comments", F.lit(None).cast(f"array<{NESTED}>")), tag, salt, collected)
    return own.unionByName(said)


# --- publisher ------------------------------------------------------------------------------------------------------


def publish(messages: DataFrame, order: list[str], send: Callable[[bytes, dict], None], attempts: int = 5, sleep: Callable[[float], None] = time.sleep, waits: str | None = None) -> int:
    """Send messages one by one in ``order`` (one ordering key), each awaited; their number.

    A failed send is repeated after 1, 2, 4, ... seconds, ``attempts`` times in all, then raised: nothing overtakes it.
    The rows come to the driver one partition at a time, as a queue with one ordering key has one writer.
    """
    sent = 0
    for row in messages.orderBy(*order).toLocalIterator():
        if waits is not None and row[waits]:
            sleep(float(row[waits]))
        for attempt in range(attempts):
            try:
                send(bytes(row["data"]), dict(row["attributes"] or {}))
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
                sleep(float(1 << attempt))
        sent += 1
    return sent
