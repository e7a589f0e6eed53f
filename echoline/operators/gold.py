"""Gold labels: language round robin, stratified picks, seats in holdout and dev, the merge of reviewed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABELS
from .evaluation import cohen_kappa
from .ranks import hash_order
from .sampling import resolve_review, review_flags

SPLITS = ("train", "dev", "holdout")


def _clean(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def stratum(label: str = "label") -> Column:
    """The label and whether the language is English."""
    return F.concat(_clean(F.col(label)), F.lit("|"), F.when(_clean(F.col("language")) == "en", "en").otherwise("non-en"))


def _first_of_language(rows: DataFrame, n: int, label: str, seed: int) -> DataFrame:
    """The first n rows in hash order of each stratum and language: all that can be among n picked ones.

    A literal bound on the row number lets each task drop the others before the exchange, so what follows sorts at most n
    rows a stratum and language.
    """
    held = rows.withColumns({"_stratum": stratum(label), "_lang": F.coalesce(F.nullif("language", F.lit("")), F.lit("und")), "_h": hash_order(seed)})
    place = F.row_number().over(Window.partitionBy("_stratum", "_lang").orderBy("_h", "id"))
    return held.withColumn("_rank", place).where(F.col("_rank") <= n)


def _picked(held: DataFrame, n: int, name: str, among: Column) -> DataFrame:
    """Add whether a row is one of the n picked among the rows of ``_first_of_language`` that ``among`` holds for."""
    part = held.withColumn("_among", among)
    strata = F.size(F.collect_set("_stratum").over(Window.partitionBy("_among")))
    rank = F.row_number().over(Window.partitionBy("_among", "_stratum", "_lang").orderBy("_h", "id"))
    part = part.withColumns({"_quota": F.greatest(F.lit(1), F.floor(F.lit(n) / strata)), "_rank": rank})
    turn = F.row_number().over(Window.partitionBy("_among", "_stratum").orderBy("_rank", "_lang"))
    part = part.withColumn("_later", turn > F.col("_quota"))
    seat = F.row_number().over(Window.partitionBy("_among").orderBy("_later", "_h", "id"))
    return part.withColumn(name, F.col("_among") & (seat <= n)).drop("_among", "_quota", "_later")


def pick_stratified(rows: DataFrame, n: int, label: str = "label", seed: int = 33) -> DataFrame:
    """n of the rows: of each label and English/other stratum max(1, n div strata), its languages taking turns.

    What is short is filled, and what is over dropped, in hash order.
    """
    if n <= 0:
        return rows.limit(0)
    held = _picked(_first_of_language(rows, n, label, seed), n, "_picked", F.lit(True))
    return held.where("_picked").select(*rows.columns)


def allocate_splits(rows: DataFrame, holdout_n: int, dev_n: int, label: str = "label", seed: int = 33) -> DataFrame:
    """Add ``split``: holdout seats first, dev seats from the rest, both stratified; everything else is train.

    Rows of one id share a split; null ids are train.
    """
    holdout_n, dev_n = max(0, holdout_n), max(0, dev_n)
    if holdout_n + dev_n == 0:
        return rows.drop("split").withColumn("split", F.lit("train"))
    first = _first_of_language(rows, holdout_n + dev_n, label, seed)
    both = _picked(_picked(first, holdout_n, "_holdout", F.lit(True)), dev_n, "_dev", ~F.col("_holdout"))
    seats = both.where("_holdout OR _dev").groupBy("id").agg(F.max(F.when(F.col("_holdout"), "holdout").otherwise("dev")).alias("_seat"))
    seated = rows.drop("split").join(F.broadcast(seats), "id", "left")  # no more than the seats asked for
    return seated.withColumn("split", F.coalesce("_seat", F.lit("train"))).drop("_seat")


def mark_review(rows: DataFrame, existing: DataFrame | None = None, holdout_target: int = 200, dev_n: int = 80, default_existing: int = 80, seed: int = 33) -> DataFrame:
    """Add review_required: model labels that are negative or unsure, and rows that will sit in holdout or dev.

    The seats are those that the gold merge will give by the model's labels: as many holdout seats as the target lacks
    beside the holdout rows of ``existing`` (without it, ``default_existing`` of them).  ``llm_confidence`` is a number
    or one of the words high and low.
    """
    there = default_existing if existing is None else existing.where(_clean(F.col("split")) == "holdout").count()
    seated = allocate_splits(rows, max(0, holdout_target - there), dev_n, "label_llm", seed).withColumnRenamed("split", "_seat")
    unsure = _clean(F.col("llm_confidence").cast("string"))
    low = (unsure == "low") | F.coalesce(F.expr("try_cast(llm_confidence AS double)") < 0.6, F.lit(False))
    flagged = review_flags(seated.withColumns({"_label_llm": F.col("label_llm"), "_llm_confidence": F.col("llm_confidence"), "label_llm": _clean(F.col("label_llm")), "llm_confidence": F.when(low, 0.0).otherwise(1.0)}), reserved=F.col("_seat") != "train")
    given = [F.col(f"_{c}").alias(c) if c in ("label_llm", "llm_confidence") else F.col(c) for c in rows.columns if c != "split"]
    return flagged.select(*given, "review_required")


def existing_gold(rows: DataFrame) -> DataFrame:
    """Gold rows with clean label and split (train unless it is one of the three) and a label source."""
    label, split = _clean(F.col("label")), _clean(F.col("split"))
    bad = F.raise_error(F.concat(F.lit("gold label must be one of pos, neu, neg: "), F.coalesce("label", F.lit("null"))))
    source = F.coalesce("label_source", F.lit("human")) if "label_source" in rows.columns else F.lit("human")
    return rows.withColumns({"label": F.when(label.isin(*LABELS), label).otherwise(bad), "split": F.when(split.isin(*SPLITS), split).otherwise("train"), "label_source": source})


def resolved(existing: DataFrame, review: DataFrame, position: str = "position") -> DataFrame:
    """New review rows with their label: the first resolved row of each id that gold does not have."""
    fresh = review.withColumn("id", F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))).where("id <> ''").join(existing.select(F.trim("id").alias("id")), "id", "left_anti")
    done = resolve_review(fresh)
    rest = [c for c in done.columns if c != "id"]
    return done.groupBy("id").agg(F.min_by(F.struct(*rest), position).alias("_first")).select("id", "_first.*")


def dropped_unreviewed(existing: DataFrame, review: DataFrame, position: str = "position") -> DataFrame:
    """One row (dropped_unreviewed): rows whose required review is missing, before their id is resolved."""
    fresh = review.where("trim(coalesce(id, '')) <> ''").join(existing.select("id"), "id", "left_anti")
    first = resolved(existing, review, position).select("id", F.col(position).alias("_done"))
    required = _clean(F.col("review_required")).isin("1", "true", "yes") & ~_clean(F.col("label")).isin(*LABELS)
    late = F.coalesce(F.col(position) > F.col("_done"), F.lit(False))
    return fresh.join(first, "id", "left").agg(F.count_if(required & ~late).alias("dropped_unreviewed"))


def prelabel_agreement(rows: DataFrame) -> DataFrame:
    """n, accuracy and kappa of people's labels against the model's, where both are of the three classes."""
    both = rows.where("label_source = 'human'").select("label", _clean(F.col("label_llm")).alias("model")).where(F.col("model").isin(*LABELS))
    same = both.agg(F.coalesce(F.avg((F.col("label") == F.col("model")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return cohen_kappa(both, "label", "model").crossJoin(same).select("n", "accuracy", "kappa")


def merge_gold(existing: DataFrame, review: DataFrame, *, holdout_target: int, dev_n: int, seed: int = 33, human_only: bool = False, position: str = "position") -> DataFrame:
    """(id, language, label, label_source, split) of old and new gold rows.

    Existing ids win.  Seats of new rows go to rows that a person labelled, then to others if some are left;
    ``human_only`` leaves the model's rows out of train.
    """
    columns = ["id", "language", "label", "label_source", "split"]
    old, new = existing_gold(existing), resolved(existing, review, position)
    needed = max(0, holdout_target - old.where("split = 'holdout'").count())
    by_person, by_model = new.where("label_source = 'human'"), new.where("label_source = 'llm'")
    people = by_person.count()  # seats go to them as long as there are any
    human = allocate_splits(by_person, needed, dev_n, seed=seed)
    held = min(needed, people)
    model = allocate_splits(by_model, needed - held, max(0, dev_n - (people - held)), seed=seed)
    whole = old.select(*columns).unionByName(human.select(*columns)).unionByName(model.select(*columns))
    return whole.where("NOT (split = 'train' AND label_source = 'llm')") if human_only else whole
