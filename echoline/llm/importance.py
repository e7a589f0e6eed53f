"""Importance resampling towards a target: documents drawn by hashed word runs that are commoner in the target's texts.

Texts are taken as UTF-8 bytes straight from Arrow buffers: a table lower-cases A-Z, another classes each byte, words lie
between the differences of neighbouring classes, and the CRC-32 of all words of a chunk advance together, one byte of
each per step.  Runs of several words carry a word's state on over one space and the next word.

1. Bucket counts of the documents and of the target are summed on Spark; at most ``buckets`` numbers reach the driver,
   which turns them into gains and sends those back.
2. A second pass sums gains per document; the score adds Gumbel noise derived from the id, so that the highest scores are
   a sample without replacement, and the same one on every run.
3. Scores are whole numbers in a range that their logarithms bound (some 130,000 values), so ranks come from one
   histogram of scores and a window inside each score: no task sees all rows.

Defined results: null and empty texts have no features and weight 0; null ids are hashed as an empty id and rank after
others of the same score; rows that repeat an id are documents of their own, drawn in the order of weight and features; an
empty table gives no rows; with an empty target only the documents' own counts decide; words of any length and bytes of any
script are taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, column

#: Bytes of text that are handled at once (a longer text by itself), and of a word that are advanced in step with others.
CHUNK, IN_STEP = 1 << 22, 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> np.uint32(1)), out >> np.uint32(1))
    return out


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each word, all words in step; the tails of very long ones by zlib."""
    order = np.argsort(lengths, kind="stable")[::-1]
    crc, at, size = state[order], starts[order], lengths[order]
    rising = size[::-1]
    for j in range(int(min(size[0], IN_STEP)) if len(size) else 0):
        k = len(size) - int(np.searchsorted(rising, j, "right"))
        c = crc[:k]
        crc[:k] = CRC[(c ^ data[at[:k] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    for i in range(len(size) - int(np.searchsorted(rising, IN_STEP, "right"))):
        rest = data[at[i] + IN_STEP : at[i] + size[i]].tobytes()
        crc[i] = zlib.crc32(rest, int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def run_hashes(raw: np.ndarray, bounds: np.ndarray, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, CRC-32) of all runs of 1, 2 ... ``runs`` words, one pair of arrays per length; documents lie between ``bounds``."""
    data = LOWER[raw]
    inside = IN_WORD[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True  # a document begins or ends
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | opens[1:-1]
    end[:-1] &= ~inside[1:] | opens[1:-1]
    starts = np.flatnonzero(begin)
    lengths = np.flatnonzero(end) + 1 - starts
    doc = np.searchsorted(bounds, starts, "right") - 1
    state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    yield doc, state ^ np.uint32(0xFFFFFFFF)
    for r in range(2, runs + 1):
        last = np.arange(r - 1, len(starts))
        whole = doc[last] == doc[last - (r - 1)] if len(last) else np.zeros(0, bool)
        state = state[: max(len(starts) - (r - 1), 0)]
        state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = advance(state, data, starts[last], lengths[last])
        yield doc[last][whole], (state ^ np.uint32(0xFFFFFFFF))[whole]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes, bounds) of runs of rows of up to ``CHUNK`` bytes, read from the array's own buffers."""
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(int(np.searchsorted(bounds, bounds[row] + CHUNK, "right")) - 1, row + 1)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def bucket_counts(texts: DataFrame, name: str, buckets: int, runs: int) -> DataFrame:
    """(bucket, ``name``) of a table's only column ``text``; each task adds its texts up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, bounds in chunks(batch.column(0)):
                for _, crc in run_hashes(raw, bounds, runs):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(texts: DataFrame, target: DataFrame, buckets: int, runs: int) -> np.ndarray:
    """Per bucket 1000 times the log of how much commoner it is in the target, floored; ``buckets`` rows on the driver."""
    both = bucket_counts(texts, "s", buckets, runs).join(bucket_counts(target, "t", buckets, runs), "bucket", "full").na.fill(0)
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in both.collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    of_docs, of_target = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * of_docs / ((x + 1.0) * of_target))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, end, raw, bounds in chunks(batch.column(1)):
                for r, (doc, crc) in enumerate(run_hashes(raw, bounds, runs)):
                    n = np.bincount(doc, minlength=end - row)
                    ends = np.cumsum(n)
                    sums = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                    total[row:end] += sums[ends] - sums[ends - n]
                    features[row:end] += n
                    if r == 0:
                        words[row:end] = n
            weight = np.where(features, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, runs: int = 1, min_words: int = 20, percent: int = 10, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one per row; rank counts the drawn ones from the highest score."""
    scratch = Scratch(docs.sparkSession)
    gain = gains(docs.select(column(text_col).cast("string").alias("text")), target.select(column(target_col).cast("string").alias("text")), buckets, runs)
    seen = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(seen, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296)))
    scored = scratch.keep(weights(docs, gain, runs, id_col, text_col).withColumn("score", (F.col("weight") + noise).cast("long")))
    may = F.col("n_words") >= min_words
    drawn = percent * scored.where(may).count() // 100
    per_score = scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")
    cut = bounded(scratch.keep(per_score.withColumn("above", above).where(F.col("above") < drawn).select("score", "above")))
    placed = scored.join(cut, "score", "left").withColumn("in", may & F.col("above").isNotNull())
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features"))
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.where("in").withColumn("rank", (F.col("above") + inside).cast("long"))
    return ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).union(
        placed.where("NOT in").select(*names, F.lit(None).cast("long").alias("rank"))
    )
