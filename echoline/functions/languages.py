"""Language detection by character n-gram profiles that are fitted on labelled texts.

A profile is the log-likelihood of hashed letter trigrams in one language; a text gets the language under which its first
``CHARS`` characters are likeliest, and null where they hold no letter.  Profiles are counted on Spark; what reaches the driver
is one row of ``BUCKETS`` numbers per language with at least ``min_rows`` texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are looked at, as the contract has it, and hashed trigrams that are told apart.
CHARS, BUCKETS = 1000, 1 << 14
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams, how many each text has); lower case, every run of other characters than letters is one space."""
    joined = "\n".join("".join(c if c.isalpha() else " " for c in (t or "")[:CHARS].lower()) for t in texts)
    codes = np.frombuffer((" " + joined + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.cumsum(codes == 10) - (codes == 10)
    codes = np.where(codes == 10, 32, codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    middle = codes[1:-1] != 32
    hashed = (codes[:-2] * _MIX[0] ^ codes[1:-1] * _MIX[1] ^ codes[2:] * _MIX[2]) >> np.uint64(7)
    return (hashed % np.uint64(BUCKETS)).astype(np.int64)[middle], np.bincount(row[1:-1][middle], minlength=len(texts))[: len(texts)]


@dataclass(frozen=True)
class Profiles:
    """``table[i]`` holds the log-likelihoods of ``names[i]``."""

    names: list[str]
    table: np.ndarray

    def best(self, texts: list[str]) -> list[str | None]:
        if not self.names:
            return [None] * len(texts)
        grams, n = trigrams(texts)
        ends = np.cumsum(n)
        sums = np.concatenate([np.zeros((len(self.names), 1)), np.cumsum(self.table[:, grams], axis=1, dtype=np.float64)], axis=1)
        top = np.argmax(sums[:, ends] - sums[:, ends - n], axis=0)
        return [self.names[i] if k else None for i, k in zip(top, n, strict=True)]


def fit(labelled: DataFrame, min_rows: int = 20, max_languages: int = 500) -> Profiles:
    """From (language, text); languages of fewer texts have no profile, rows without language count for none.

    More than ``max_languages`` languages raise: they are dirty marks, for which ``min_rows`` is too small.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                grams, _ = trigrams([t for x, t in zip(names, texts, strict=True) if x == name])
                total[name] = total.get(name, 0) + np.bincount(grams, minlength=BUCKETS)
        for name, n in total.items():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held), pa.array(n[held])], ["language", "bucket", "n"])

    rows = labelled.where("language IS NOT NULL AND text IS NOT NULL").select("language", "text")
    known = rows.groupBy("language").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_rows).select("language")
    names = [r.language for r in known.limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages have {min_rows} texts")
    counts = rows.where(F.col("language").isin(names)).mapInArrow(count, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    per = counts.groupBy("language").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).orderBy("language").collect()
    table = np.full((len(per), BUCKETS), 0.5)
    for i, row in enumerate(per):
        table[i, row.b] += row.n
    return Profiles([row.language for row in per], np.log(table / table.sum(axis=1, keepdims=True)))


def detector(profiles: Profiles) -> Callable[[Column], Column]:
    """A Column function from text to language."""

    @F.pandas_udf("string")
    def detect(texts: pd.Series) -> pd.Series:
        return pd.Series(profiles.best(texts.tolist()), index=texts.index, dtype=object)

    return detect
