"""Language identification by Bayesian evidence fusion.

Evidence about a document's language: the likelihood of its whole text under byte-trigram models, the language that
its markup declares, the suffix of its address, and a prior of its host.  The prior is smoothed hierarchically
(host, domain, suffix, all) from counts of the languages that the texts alone suggest, by grouped aggregation over all
rows.  A further class "und" (unknown) explains text that no model fits.

The languages are all that label a row with text; each one's trigram model is fitted on at most ``train_rows`` of its
distinct texts (whole texts, those of the smallest digests); everything else covers all rows.

Defined results: null, empty or letterless text is "und" with posterior 1 and is rejected; missing, empty,
"und" or unknown declarations, malformed or missing addresses and hosts are no evidence; texts of any length are read
whole, in pieces; equal rows get equal results, rows that share an id are judged each by their own text and marks; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, column, materialize, unused

BUCKETS = 1 << 15
#: Overlapping trigrams are not independent; their joint log-likelihood is taken to this power.
POWER = 1 / 3
UNKNOWN = "und"
PIECE = 1 << 20

#: Languages that country suffixes suggest.
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "fr": "fr",
    "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en",
}

#: Bytes by class: letters in lower case, bytes of other scripts as they are, anything else a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: bytes) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a text, a space before and after it."""
    b = np.empty(len(raw) + 2, np.uint32)
    b[0] = b[-1] = 32
    b[1:-1] = _FOLD[np.frombuffer(raw, np.uint8)]
    return (b[:-2] * np.uint32(7919) + b[1:-1] * np.uint32(104_729) + b[2:] * np.uint32(1_299_709)) & np.uint32(BUCKETS - 1)


def has_letters(raw: bytes) -> bool:
    return bool((_FOLD[np.frombuffer(raw, np.uint8)] != 32).any())


def fit(labelled: DataFrame, train_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of buckets, from (language, text) rows; counts are summed in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own = sums.setdefault(language, np.zeros(BUCKETS, np.int64))
                for i in range(0, len(raw), PIECE):
                    own += np.bincount(trigrams(raw[i : i + PIECE]), minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["language", "counts"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each digest, of which there are at most ``train_rows`` a language."""
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    usable = labelled.where(f"language IS NOT NULL AND language NOT IN ('', '{UNKNOWN}') AND text IS NOT NULL AND text <> ''")
    usable = usable.withColumn("digest", F.xxhash64("language", "text"))
    # each language's bound on the digest first, so that only the sample's texts move; equal rows count once
    rank = F.row_number().over(Window.partitionBy("language").orderBy("digest"))
    bounds = usable.select("language", "digest").distinct().withColumn("rank", rank).where(F.col("rank") <= train_rows).groupBy("language").agg(F.max("digest").alias("bound"))
    sample = usable.join(F.broadcast(bounds), "language").where("digest <= bound").select("language", "text", "digest")
    sample = sample.mapInArrow(once, "language string, text string, digest long").repartition("language").mapInArrow(once, "language string, text string, digest long")
    sums: dict[str, np.ndarray] = {}
    for language, counts in sample.select("language", "text").mapInArrow(count, "language string, counts binary").collect():
        sums[language] = sums.get(language, 0) + np.frombuffer(counts, np.int64)
    languages = sorted(sums)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    smooth = np.stack([(sums[x] + 0.1) / (sums[x].sum() + 0.1 * BUCKETS) for x in languages])
    return languages, np.log(smooth)


def _scores(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """Add ``ll``: tempered log-likelihoods of the languages and of "und"; null where the text has no letters."""
    names = ["doc_id", "declared", "host", "suffix", "n_bytes", "text_hash", "ll"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item in batch.column(6):
                buffer = item.as_buffer()
                raw = buffer.to_pybytes() if buffer is not None else b""
                if not has_letters(raw):
                    out.append(None)
                    continue
                sums, n = np.zeros(len(languages)), 0
                for i in range(0, len(raw), PIECE):
                    grams = trigrams(raw[i : i + PIECE])
                    n += len(grams)
                    for k in range(len(languages)):
                        sums[k] += table[k][grams].sum()
                out.append([*(sums * POWER).tolist(), -np.log(BUCKETS) * n * POWER])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.list_(pa.float64()))], names)

    return rows.mapInArrow(score, "doc_id long, declared string, host string, suffix string, n_bytes long, text_hash long, ll array<double>")


def row_key(*names: str | None) -> Column:
    """A digest of what a row's result rests on, nulls told from empty values."""
    values = [column(n).cast("string") for n in names if n]
    return F.xxhash64(*[F.struct(v.isNull(), v) for v in values])


def identify(
    docs: DataFrame,
    *,
    labelled: DataFrame | None = None,
    train_rows: int = 2000,
    declared_error: float = 0.1,
    suffix_error: float = 0.2,
    strength: float = 20.0,
    threshold: float = 0.5,
    unknown_prior: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    url_col: str | None = None,
    host_col: str | None = "source",
) -> DataFrame:
    """(doc_id, text_hash, declared, language, posterior, kept), one per row; text_hash digests text, mark and host.

    ``labelled`` (language, text) trains the models; without it the rows' own declarations do.
    ``url_col`` gives host and suffix where there are addresses; else ``host_col`` names the host.
    """
    none = F.lit(None).cast("string")
    declared = F.lower(F.substring_index(F.trim(column(declared_col)), "-", 1)) if declared_col else none
    host = F.lower(F.try_parse_url(column(url_col), F.lit("HOST"))) if url_col else column(host_col).cast("string") if host_col else none
    suffix = F.when(host.contains("."), F.substring_index(host, ".", -1)) if url_col else none
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"),
        F.coalesce(F.octet_length(column(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        row_key(text_col, declared_col, url_col or host_col).alias("text_hash"), column(text_col).alias("text"),
    )
    languages, table = fit(labelled if labelled is not None else rows.select(F.col("declared").alias("language"), "text"), train_rows)
    scored = materialize(_scores(rows, languages, table))
    if not languages:
        return scored.select("doc_id", "text_hash", "declared", F.lit(UNKNOWN).alias("language"), F.lit(1.0).alias("posterior"), F.lit(False).alias("kept"))
    classes = [*languages, UNKNOWN]
    scored = scored.withColumn("domain", F.when(F.col("suffix").isNotNull(), F.substring_index("host", ".", -2)))
    guess = F.array_position(F.col("ll"), F.array_max("ll"))
    counts = [F.count_if(guess == i + 1).alias(f"n{i}") for i in range(len(languages))]
    per_host = materialize(scored.where("ll IS NOT NULL").groupBy("host", "domain", "suffix").agg(*counts))
    sums = [F.sum(f"n{i}").cast("double").alias(f"n{i}") for i in range(len(languages))]

    def smooth(frame: DataFrame, parent: list[Column], prefix: str) -> DataFrame:
        total = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(languages))])
        return frame.withColumns({f"{prefix}{i}": (F.col(f"n{i}") + strength * parent[i]) / (total + strength) for i in range(len(languages))})

    flat = [F.lit(1 / len(languages))] * len(languages)
    top = smooth(per_host.agg(*[F.coalesce(x, F.lit(0.0)).alias(f"n{i}") for i, x in enumerate(sums)]), flat, "g").first()
    above = [F.lit(float(top[f"g{i}"])) for i in range(len(languages))]
    pick = lambda p: [f"{p}{i}" for i in range(len(languages))]
    by_suffix = smooth(per_host.where("suffix IS NOT NULL").groupBy("suffix").agg(*sums), above, "s").select("suffix", *pick("s"))
    suffix_prior = [F.coalesce(F.col(f"s{i}"), above[i]) for i in range(len(languages))]
    by_domain = smooth(
        per_host.where("domain IS NOT NULL").groupBy("suffix", "domain").agg(*sums).join(by_suffix, "suffix", "left"), suffix_prior, "d"
    ).select("domain", *pick("d"))
    hosts = smooth(
        per_host.where("host IS NOT NULL").join(by_suffix, "suffix", "left").join(by_domain, "domain", "left"),
        [F.coalesce(F.col(f"d{i}"), suffix_prior[i]) for i in range(len(languages))],
        "h",
    ).select("host", *pick("h"))

    others = max(len(languages) - 1, 1)
    known = F.col("declared").isin(languages)
    told = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])[F.col("suffix")]
    useful = told.isin(languages)

    def evidence(i: int, name: str) -> Column:
        prior = F.log(F.coalesce(F.col(f"h{i}"), above[i]) * (1 - unknown_prior))
        mark = F.when(known, F.when(F.col("declared") == name, np.log(1 - declared_error)).otherwise(np.log(declared_error / others))).otherwise(0.0)
        address = F.when(useful, F.when(told == name, np.log(1 - suffix_error)).otherwise(np.log(suffix_error / others))).otherwise(0.0)
        return F.col("ll")[i] + prior + mark + address

    blank = np.log(unknown_prior)
    joint = F.array(*[*(evidence(i, x) for i, x in enumerate(languages)), F.col("ll")[len(languages)] + F.lit(blank) + F.when(known, -np.log(len(languages))).otherwise(0.0)])
    fused = scored.join(hosts, "host", "left").select("doc_id", "text_hash", "declared", "ll", joint.alias("joint"))
    peak = F.array_max("joint")
    posterior = 1 / F.aggregate("joint", F.lit(0.0), lambda a, x: a + F.exp(x - peak))
    language = F.element_at(F.array(*[F.lit(x) for x in classes]), F.array_position("joint", peak).cast("int"))
    unread = F.col("ll").isNull()
    return fused.select(
        "doc_id", "text_hash", "declared",
        F.when(unread, UNKNOWN).otherwise(language).alias("language"),
        F.when(unread, 1.0).otherwise(posterior).alias("posterior"),
        (~unread & (language != UNKNOWN) & (posterior >= threshold)).alias("kept"),
    )


def keep_identified(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", declared_col: str | None = "lang", url_col: str | None = None, host_col: str | None = "source", **options) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects, columns unchanged.

    The keys of the rejected rows are broadcast where few enough, so the texts do not move.
    """
    found = identify(docs, text_col=text_col, id_col=id_col, declared_col=declared_col, url_col=url_col, host_col=host_col, **options)
    key, digest = unused(docs, "key", "digest")
    bad = Scratch(docs.sparkSession).keep(found.where("NOT kept").select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct())
    same = column(id_col).cast("long").eqNullSafe(F.col(key)) & (row_key(text_col, declared_col, url_col or host_col) == F.col(digest))
    return docs.join(bounded(bad), same, "left_anti")


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, url, declared, text) of raw pages: the ``lang`` of the html element and the text without markup."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit(""))
    return pages.select("page_id", "url", declared.alias("declared"), bare.alias("text"))
