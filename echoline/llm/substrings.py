"""Substring dedup by hashing lines, paragraphs or sentences.

Texts are cut into units; a unit is normalised (lower case, single spaces) and digested to 128 bits; digests are
grouped over the whole corpus, the occurrence of the earliest rank (doc_id, start) stays and the rest are removed.
Offsets are in characters of the original text.

Only digests and offsets move; texts stay where they are until ``remove`` applies the spans.

Defined results: null and empty texts have no units; units under ``min_words`` words are left alone; null ids rank
last; several texts of one id, or of none, are told apart by a digest ``t`` of the text; rows that repeat id and text
count as one document (their equal places do not remove each other); an empty table gives no spans; a unit repeated
inside one document is removed but for its first place; texts and units of any length are taken whole; other columns are
ignored, whatever their names.

``passage_spans`` also finds passages that start or end inside units or consist of short ones: every run of
``run_words`` words (lower case, any white space between them) that an earlier place holds is covered, and runs that
overlap give one span.  Runs are not all shuffled: of any ``run_words`` words the q-gram with the smallest hash is an
anchor, equal runs have equal anchors, so only runs round an anchor that occurs twice are compared, and none is missed.
Neighbouring anchors overlap or touch; where the earliest places of several lie as they do, all between them is equal,
so that stretch is covered as it is and only the runs across its ends are compared, with all runs of the earliest place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, materialize, text_hash, unused

#: What separates units.
SEPARATORS = {
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n[ \t]*\n\s*"),
    "sentence": re.compile(r"(?<=[.!?])\s+|\n+"),
}

#: Words of a run that ``passage_spans`` compares, and of its anchors.
RUN_WORDS, ANCHOR_WORDS = 39, 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def units_of(text: str, separator: re.Pattern, min_words: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of each unit of at least ``min_words`` words."""
    at = 0
    for gap in [*separator.finditer(text), None]:
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        if len(words) >= min_words:
            yield at, end, len(words), " ".join(words).lower()
        at = gap.end() if gap else end


def units(docs: DataFrame, *, unit: str, min_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    separator = SEPARATORS[unit]
    names = ["doc_id", "t", "start", "end", "words", "h1", "h2"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            numbers = np.array(places, np.int64).reshape(-1, 3)
            columns = [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), *(pa.array(numbers[:, i]) for i in range(3)), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            return pa.RecordBatch.from_arrays(columns, names)

        ids, marks, places, digests = [], [], [], []
        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for start, end, words, norm in units_of(text.as_py() or "", separator, min_words):
                    ids.append(doc_id)
                    marks.append(mark)
                    places.append((start, end, words))
                    digests.append(hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    if len(ids) >= 20_000:
                        yield pack()
                        ids, marks, places, digests = [], [], [], []
        if ids:
            yield pack()

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), text_hash(column(text_col)).alias("t"), column(text_col).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, t long, start long, end long, words long, h1 long, h2 long")


def duplicate_spans(docs: DataFrame, *, unit: str = "sentence", min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to remove: (doc_id, t, start, end, words, kept_doc_id, kept_start)."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(units(docs, unit=unit, min_words=min_words, id_col=id_col, text_col=text_col))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "t")
    first = (
        found.groupBy("h1", "h2")
        .agg(F.min(rank).alias("kept"), F.max(rank).alias("other"))
        .where("kept <> other")
        .select("h1", "h2", "kept")
    )
    first = scratch.keep(first)  # an exchange of its own: a very common unit's partition can be split
    return (
        found.join(first, ["h1", "h2"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("start") == F.col("kept.start")) & (F.col("t") == F.col("kept.t"))))
        .select("doc_id", "t", "start", "end", "words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))
        .distinct()
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is white space, and a number that its lower case shares."""
    low = np.arange(0x110000, dtype=np.uint64)
    space = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        space[i] = c.isspace()
        if len(x := c.lower()) == 1:
            low[i] = ord(x)
    return space, _mix(low + np.uint64(1))


@lru_cache(16)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(base, -1, 1 << 64)
    both = []
    for b in (base, back):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x, dtype=np.uint64))
    return both[0], both[1]


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end], whatever is before them."""
    up, down = _powers(base, 1 << max(12, len(values).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts])


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space, number = _characters()
    edge = np.ones(len(points) + 2, bool)
    edge[1:-1] = space[points]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = at[::2], at[1::2]
    return starts, ends, _sums(number[points], starts, ends, BASES[0]) + (ends - starts).astype(np.uint64)


def _runs(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    first = np.arange(max(len(hashes) - size + 1, 0))
    return _sums(hashes, first, first + size, base)


def anchors_of(hashes: np.ndarray, run_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the anchors: each run of ``run_words`` words holds the one of its smallest hash."""
    if len(hashes) < run_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _runs(hashes, anchor_words, BASES[1])
    windows = np.lib.stride_tricks.sliding_window_view(grams, run_words - anchor_words + 1)
    first = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return first, grams[first]


_PLACES = "doc_id long, text_hash long, start long, end long, first long, last long, h1 long, h2 long"


def _batches(parts: Iterator[tuple], columns: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (doc_id, text_hash, matrix of ``columns`` integer columns)."""
    names = [x.split()[0] for x in _PLACES.split(", ")]
    ids, marks, sizes, rows, held = [], [], [], [], 0

    def pack() -> pa.RecordBatch:
        of = np.repeat(np.arange(len(ids)), sizes)
        numbers = np.concatenate(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()).take(pa.array(of)), pa.array(np.array(marks, np.int64)[of]), *(pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(columns))], names
        )

    for doc_id, mark, matrix in parts:
        for i in range(0, len(matrix), 20_000):
            part = matrix[i : i + 20_000]
            ids.append(doc_id), marks.append(mark), sizes.append(len(part)), rows.append(part)
            held += len(part)
            if held >= 20_000:
                yield pack()
                ids, marks, sizes, rows, held = [], [], [], [], 0
    if ids:
        yield pack()


def _matrix(starts, ends, first, last, h1, h2) -> np.ndarray:
    halves = [np.asarray(x, np.uint64).view(np.int64) for x in (h1, h2)]
    return np.stack([np.asarray(x, np.int64) for x in (starts, ends, first, last)] + halves, axis=1)


def passage_spans(
    docs: DataFrame,
    *,
    unit: str = "sentence",
    min_words: int = 8,
    run_words: int = RUN_WORDS,
    anchor_words: int = ANCHOR_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans to remove: (doc_id, t, start, end, words, kept_doc_id, kept_start), those of one text apart from each other.

    Units that an earlier place holds, as by ``duplicate_spans``, and runs of at least ``run_words`` words that do.
    Rows that share an id are one document here: equal places of theirs do not cover each other.
    ``kept_*`` is the earliest place of the unit or run that a span begins with.  A removed word has an earlier copy
    within a repeated run, so following them ends at one that stays.
    """
    separator = SEPARATORS[unit]
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), text_hash(column(text_col)).alias("text_hash"), column(text_col).alias("text"))
    rows = rows.where("text IS NOT NULL AND text <> ''")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, mark, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    text, number, places, digests = item.as_py(), 0, [], []
                    for start, end, words, norm in units_of(text, separator, 1):
                        if words >= min_words:
                            places.append((start, end, number, number + words - 1))
                            digests.append(hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                        number += words
                    if places:
                        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                        yield doc_id, mark, np.concatenate([np.array(places, np.int64), halves], axis=1)
                    if number >= run_words:
                        starts, _, hashes = words_of(text)
                        first, grams = anchors_of(hashes, run_words, anchor_words)
                        # an end of -1 marks an anchor
                        yield doc_id, mark, _matrix(starts[first], np.full(len(first), -1), first, np.full(len(first), -1), grams, np.zeros(len(first)))

        return _batches(parts(), 6)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, mark, item, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    starts, ends, hashes = words_of(item.as_py())
                    count = len(hashes) - run_words + 1
                    anchors = sorted({(a["first"], a["origin"], a["own"], a["kept_id"], a["kept_start"]) for a in at.as_py()}, key=lambda a: a[0])
                    # a run that starts at i holds the anchors that start from i to i + run_words - anchor_words
                    first = np.array([a[0] for a in anchors], np.int64)
                    change = np.zeros(count + run_words + 1, np.int64)
                    np.add.at(change, np.maximum(first - (run_words - anchor_words), 0), 1)
                    np.add.at(change, first + 1, -1)
                    near = np.cumsum(change)[:count] > 0
                    stretches, i = [], 0
                    while i < len(anchors):
                        j = i
                        while j + 1 < len(anchors) and anchors[j + 1][1] == anchors[i][1] and anchors[j + 1][0] - anchors[j][0] <= anchor_words:
                            j += 1
                        a, b = anchors[i][0], anchors[j][0] + anchor_words
                        if not anchors[i][2] and b - a >= run_words:
                            near[a : b - run_words + 1] = False
                            stretches.append((starts[a], ends[b - 1], a, b - 1, anchors[i][3], anchors[i][4], anchors[i][3] is None))
                        i = j + 1
                    near = np.flatnonzero(near)
                    h1, h2 = (_runs(hashes, run_words, b)[near] for b in BASES)
                    # runs that the text itself has before are covered as they are
                    _, one, of = np.unique(h1, return_index=True, return_inverse=True)
                    once = one[of] == np.arange(len(near))
                    held = np.flatnonzero(~once)
                    for part in np.split(held, np.flatnonzero(np.diff(near[held]) != 1) + 1) if len(held) else []:
                        a, b = near[part[0]], near[part[-1]] + run_words
                        stretches.append((starts[a], ends[b - 1], a, b - 1, doc_id, starts[near[one[of[part[0]]]]], doc_id is None))
                    near, h1, h2 = near[once], h1[once], h2[once]
                    yield doc_id, mark, _matrix(starts[near], ends[near + run_words - 1], near, np.full(len(near), -1), h1, h2)
                    # an end below 0 marks a stretch: there h1 and h2 are the id and start of its earlier place
                    known = [(x[0], -x[1] - (1 << 40) * x[6], x[2], x[3], x[4] or 0, x[5]) for x in stretches]
                    yield doc_id, mark, np.array(known, np.int64).reshape(-1, 6)

        return _batches(parts(), 6)

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "first", "text_hash")
    equal = Window.partitionBy("h1", "h2", (F.col("end") < 0))
    found = rows.mapInArrow(cut, _PLACES).withColumns({"kept": F.min(place).over(equal), "other": F.max(place).over(equal)})
    again = F.struct("kept.doc_id", "kept.start") != F.struct("other.doc_id", "other.start")
    found = materialize(found.where(F.coalesce(again, F.lit(True))).drop("other", "h1", "h2"))
    own = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("start") == F.col("kept.start"))
    origin = F.xxhash64("kept.doc_id", "kept.text_hash", F.col("kept.first") - F.col("first"))
    mark = F.struct("first", origin.alias("origin"), own.alias("own"), F.col("kept.doc_id").alias("kept_id"), F.col("kept.start").alias("kept_start"))
    at = found.where("end < 0").groupBy("doc_id", "text_hash").agg(F.collect_set(mark).alias("at")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    near = rows.join(at, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", "text", "at")
    earlier = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    compared = near.mapInArrow(runs, _PLACES)
    compared = compared.withColumn("kept", F.min(earlier).over(Window.partitionBy("h1", "h2", F.when(F.col("end") < 0, F.xxhash64("doc_id", "text_hash", "first")))))
    absent = F.col("end") < -(1 << 40)
    told = F.struct(absent.alias("last"), F.when(~absent, F.col("h1")).alias("doc_id"), F.col("h2").alias("start"))
    compared = compared.withColumn("kept", F.when(F.col("end") < 0, told).otherwise(F.col("kept")))
    compared = compared.withColumns({"end": F.abs("end") % F.lit(1 << 40), "last": F.when(F.col("last") < 0, F.col("first") + run_words - 1).otherwise(F.col("last"))}).drop("h1", "h2")
    hits = found.where("end >= 0").withColumn("kept", F.struct("kept.last", "kept.doc_id", "kept.start")).unionByName(compared)
    hits = hits.where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("start") == F.col("kept.start"))))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("opens", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    hits = hits.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        hits.groupBy("doc_id", "text_hash", "island")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first") + 1).alias("words"),
            F.min(F.struct("start", "kept")).alias("begin"),
        )
        .select("doc_id", F.col("text_hash").alias("t"), "start", "end", "words", F.col("begin.kept.doc_id").alias("kept_doc_id"), F.col("begin.kept.start").alias("kept_start"))
        .distinct()
    )


def remove(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans (doc_id, t, start, end) cut out of the text; documents without spans are untouched.

    The spans of one document, at most its number of units, are gathered beside its text.
    """
    key, mark, cut, out = unused(docs, "cut_id", "cut_text", "cut", "cut_out")
    per_doc = spans.groupBy(F.col("doc_id").alias(key), F.col("t").alias(mark)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cut))
    text, at = column(text_col), F.col(cut)
    before = lambda i: F.when(i > 0, F.try_element_at(at, i)["end"]).otherwise(F.lit(0))
    after = lambda i: F.coalesce(F.try_element_at(at, i + 1)["start"], F.length(text).cast("long"))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(at)),
        lambda i: F.substring(text, (before(i) + 1).cast("int"), (after(i) - before(i)).cast("int")),
    )
    joined = docs.join(per_doc, column(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash(text) == F.col(mark)), "left")
    joined = joined.withColumn(out, F.when(at.isNull(), text).otherwise(F.array_join(kept, "")))
    return joined.select(*[F.col(out).alias(n) if n == text_col else column(n) for n in docs.columns])
