"""Training rows (text, label, source) from labelled corpora, and the mixes made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import corpus_label, emotion_class, normalise
from .sampling import oversample, proportional, reservoir

COLUMNS = ("text", "label", "source")


def mapped(rows: DataFrame, corpus: str, text: str = "text", label: str = "label") -> DataFrame:
    """A corpus's rows as training rows, texts normalised, empty ones dropped; extra columns stay."""
    own = emotion_class(F.col(label)) if corpus == "goemotions" else corpus_label(corpus, F.col(label))
    out = rows.withColumns({"label": own, "text": normalise(F.col(text)), "source": F.lit(corpus)})
    return out.where("text <> ''")


def gold_rows(rows: DataFrame, keep: str | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Gold rows of one split, or of all but some; a kept row without text or label is an error."""
    split = F.lower(F.trim(F.coalesce("split", F.lit(""))))
    held = rows.where(~split.isin(*skip)) if skip else rows
    held = held.where(split == keep.strip().lower()) if keep is not None else held
    text, label = normalise(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("label", F.lit("")))
    # A partition number is no plain value, so the check stays above the joins and filters that chose the rows; below, it would hit others.
    lacking = F.raise_error(F.when(F.spark_partition_id() >= 0, F.lit("both text and label are required")))
    return held.withColumns({"text": F.when((text == "") | (label == ""), lacking).otherwise(text), "label": label, "source": F.coalesce(F.nullif("source", F.lit("")), F.lit("own_domain"))})


def own_domain(rows: DataFrame) -> DataFrame:
    """Gold rows that may be trained on."""
    return gold_rows(rows, skip=("holdout", "dev"))


def concatenate(*parts: DataFrame) -> DataFrame:
    """All parts' rows whose text is not blank."""
    columns = ["id", *COLUMNS]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).where(F.trim("text") != "")


def corpus_mix(parts: dict[str, DataFrame], targets: dict[str, int], own: DataFrame | None = None, factor: int = 1, seed: int = 33) -> DataFrame:
    """The named parts, those with a target cut down to it in proportion to their labels, and gold rows ``factor`` times."""
    cut = [proportional(p, targets[k], seed=seed) if k in targets else p for k, p in parts.items()]
    return concatenate(*cut, *([oversample(own_domain(own), factor).drop("copy")] if own is not None else []))


def balanced_sample(rows: DataFrame, per_language: int, seed: int = 33) -> DataFrame:
    """A third of the cap for each label of each language."""
    return reservoir(rows, per_language // 3, ["language", "label"], seed)


def stage2_rows(gold: DataFrame, pool: DataFrame, factor: int, replay_n: int, seed: int = 33) -> DataFrame:
    """Gold train rows ``factor`` times and a sample of the mix against forgetting; none where ``replay_n`` is 0."""
    own = oversample(own_domain(gold), factor).drop("copy")
    return concatenate(own, proportional(pool, replay_n, seed=seed)) if replay_n > 0 else concatenate(own)
