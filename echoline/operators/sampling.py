"""Stratified and deterministic sampling, splits, chunks and corpus mixes; order comes from seeded hashes, not generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABELS
from .distinct import first_by_id_or_text
from .durable import durable
from .ranks import hash_bucket, hash_counts, hash_order, hash_rank, number


def md5_number(key: str = "id") -> Column:
    return F.conv(F.substring(F.md5(F.col(key)), 1, 15), 16, 10).cast("long")


def gold_sample(staging: DataFrame, size: int = 300) -> DataFrame:
    """Per (source, language) stratum the first ``size div strata`` usable rows in hash order, at least one; then ``size``."""
    usable = staging.where("text IS NOT NULL AND length(trim(text)) >= 8")
    stratum = [F.col("source"), F.coalesce("language", F.lit("und"))]
    strata = usable.agg(F.countDistinct(F.concat(stratum[0], F.lit("|"), stratum[1])).alias("_strata"))
    ranked = usable.withColumn("_rn", F.row_number().over(Window.partitionBy(*stratum).orderBy(md5_number(), "id")))
    chosen = ranked.crossJoin(F.broadcast(strata)).where(F.col("_rn") <= F.greatest(F.lit(1), F.expr(f"{size} div _strata")))
    return chosen.orderBy("source", "language", "id").limit(size).drop("_rn", "_strata")


def stratified(rows: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows: max(1, n div strata) of each stratum in hash order, the rest filled by hash order over all."""
    strata = rows.select(*keys).distinct().count() or 1
    ranked = hash_rank(rows, keys, seed).withColumn("_first", F.col("_rank") <= max(1, n // strata)).withColumn("_h", hash_order(seed))
    return ranked.orderBy(F.desc("_first"), "_h", "id").limit(n).drop("_first", "_h", "_rank")


def prelabel_candidates(rows: DataFrame, gold: DataFrame, position: str, mark_col: str | None = None) -> DataFrame:
    """Rows outside gold with id and text; of those that share an id or a text, what a walk by position keeps.

    ``mark_col``: the column of ``text_mark``, where rows were given one.
    """
    return first_by_id_or_text(rows, position, mark_col=mark_col, known=gold.select("id"))[0]


def prelabel_rows(candidates: DataFrame) -> DataFrame:
    """Candidates in the shape that a model labels: texts never null, empty label and confidence, and where it came from."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in candidates.columns else F.lit("")
    more = [F.col(c) for c in ("source", "created_utc") if c in candidates.columns]
    return candidates.select(*[told(c).alias(c) for c in ("id", "text", "language", "event_tag")], F.lit("").alias("label_llm"), F.lit("").alias("llm_confidence"), *more)


def chunk_packs(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Chunk numbers (from 0) of ``size`` rows each in ``order``, a whole-number column that may have gaps."""
    return number(rows, order).withColumn("chunk", F.expr(f"(_number - 1) div {size}")).drop("_number")


def _class_sizes(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))


def train_eval_split(rows: DataFrame, share: float, label: str = "label", seed: int = 42) -> DataFrame:
    """Per class round(n * share) rows to eval, at least one where the class has several."""
    ranked, n = hash_rank(rows, [label], seed), F.col("_size")
    wanted = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share)))).otherwise(0)
    part = F.when(F.col("_rank") <= wanted, "eval").otherwise("train")
    both = ranked.join(F.broadcast(_class_sizes(rows, label)), F.col(label).eqNullSafe(F.col("_label")))  # one row a class
    return both.withColumn("part", part).drop("_rank", "_size", "_label")


def reservoir(rows: DataFrame, per_group: int, keys: list[str], seed: int = 42) -> DataFrame:
    return hash_rank(rows, keys, seed).where(F.col("_rank") <= per_group).drop("_rank")


def proportional(rows: DataFrame, n: int, label: str = "label", seed: int = 42) -> DataFrame:
    """n rows that keep the label shares (half-even rounding); what rounding leaves open is filled in hash order.

    A class gives the first rows in hash order that its share takes, and of the others no more than are open.  So only rows of
    the buckets that these positions reach are ranked and shuffled; the counts of all rows tell which those are.
    """
    if n <= 0:
        return rows.limit(0)
    counts = durable(hash_counts(rows, [label], seed))
    sizes = counts.groupBy(F.col("_g0").alias("_label")).agg(F.sum("_n").alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    if n >= total:
        return rows
    sizes = sizes.withColumn("_share", F.bround(F.col("_size") * n / total))
    left = max(0, n - int(sizes.agg(F.sum("_share")).first()[0]))
    reached = counts.join(F.broadcast(sizes), F.col("_g0").eqNullSafe(F.col("_label"))).where(F.col("_before") < F.col("_share") + left)
    reach = durable(reached.groupBy("_label", "_share").agg(F.max("_b").alias("_last")))
    widest = reach.agg(F.max("_last")).first()[0]
    near = rows.where(hash_bucket(seed) <= F.lit(widest))  # a plain bound, which goes below the joins that made the rows
    near = near.join(F.broadcast(reach), F.col(label).eqNullSafe(F.col("_label"))).where(hash_bucket(seed) <= F.col("_last"))
    both = hash_rank(near, [label], seed, counts=counts)
    both = both.withColumn("_take", F.col("_rank") <= F.col("_share")).withColumn("_h", hash_order(seed))
    return both.orderBy(F.desc("_take"), "_h", "id").limit(n).drop("_take", "_h", "_rank", "_share", "_last", "_label")


def oversample(rows: DataFrame, factor: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))


def review_flags(rows: DataFrame, low: float = 0.6, reserved: Column | None = None) -> DataFrame:
    """Rows that a person must see: negative, unsure, or meant for holdout or dev."""
    flag = (F.col("label_llm") == "neg") | (F.col("llm_confidence") < low)
    return rows.withColumn("review_required", F.coalesce(flag, F.lit(True)) | (reserved if reserved is not None else F.lit(False)))


def resolve_review(rows: DataFrame) -> DataFrame:
    """A person's label, else the model's where no review was required; rows with a required, missing review go.

    ``label_source`` tells whose it is.  A model's label outside the classes is an error where it would be needed.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    required = clean("review_required").isin("1", "true", "yes")
    human, model = clean("label"), clean("label_llm")
    bad = F.raise_error(F.concat(F.lit("label_llm must be one of pos, neu, neg: "), F.coalesce("label_llm", F.lit("null"))))
    source = F.when(human.isin(*LABELS), "human").when(~required, "llm")
    label = F.when(human.isin(*LABELS), human).when(required, None).when(model.isin(*LABELS), model).otherwise(bad)
    return rows.withColumn("label_source", source).withColumn("label", label).where("label_source IS NOT NULL")
