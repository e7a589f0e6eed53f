"""Classifier evaluation in one aggregation pass: confusion, precision/recall/F1, agreement, class weights, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import apply_threshold
from ..schemas import LABELS


def last_predictions(predictions: DataFrame, position: str = "pos") -> DataFrame:
    """The row of each id with the highest position; of equal positions, the one whose JSON comes last."""
    last = Window.partitionBy("id").orderBy(F.col(position).desc(), F.to_json(F.struct(*predictions.columns)).desc())
    return predictions.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def confusion(rows: DataFrame) -> DataFrame:
    """Zero-filled (gold, pred, n) over the three labels and any others that occur."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(x,) for x in LABELS], "label string")
    labels = fixed.union(rows.select("gold")).union(rows.select("pred")).distinct()
    grid = labels.select(F.col("label").alias("gold")).crossJoin(F.broadcast(labels.select(F.col("label").alias("pred"))))
    return grid.join(rows.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")), ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, P/R/F1 of each label and their macro means, per group of ``by``; undefined ratios are 0."""
    hit = lambda g, p: F.count_if(g & p)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("_right")]
    for x in LABELS:
        g, p = F.col("gold") == x, F.col("pred") == x
        aggs += [hit(g, p).alias(f"_tp_{x}"), hit(~g, p).alias(f"_fp_{x}"), hit(g, ~p).alias(f"_fn_{x}")]
    sums = rows.groupBy(*by).agg(*aggs)
    out = {"accuracy": _ratio(F.col("_right"), F.col("n"))}
    for x in LABELS:
        tp, fp, fn = (F.col(f"_{k}_{x}") for k in ("tp", "fp", "fn"))
        out |= {f"precision_{x}": _ratio(tp, tp + fp), f"recall_{x}": _ratio(tp, tp + fn), f"f1_{x}": _ratio(2 * tp, 2 * tp + fp + fn)}
    for m in ("precision", "recall", "f1"):
        out[f"macro_{m}"] = sum((out[f"{m}_{x}"] for x in LABELS[1:]), out[f"{m}_{LABELS[0]}"]) / len(LABELS)
    return sums.select(*by, "n", *[v.alias(k) for k, v in out.items()])


def metrics_by_slice(rows: DataFrame) -> DataFrame:
    """The metrics over all rows and per language, English or not, source and split."""
    bucket = F.when(F.lower(F.trim("language")) == "en", "en").otherwise("non-en")
    kinds = {"all": F.lit("all"), "language": F.col("language"), "en": bucket, "source": F.col("source"), "split": F.col("split")}
    slices = F.explode(F.array(*[F.struct(F.lit(k).alias("slice_kind"), v.alias("slice")) for k, v in kinds.items()]))
    return metrics(rows.select("gold", "pred", slices.alias("s")).select("gold", "pred", "s.*"), "slice_kind", "slice")


def cohen_kappa(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Chance-corrected agreement: 0 for no rows; 1 or 0 where chance alone agrees fully."""
    pairs = rows.groupBy(one, two).agg(F.count(F.lit(1)).alias("c"))
    total = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col(one) == F.col(two), F.col("c"))), F.lit(0)).alias("same"))
    a = pairs.groupBy(F.col(one).alias("k")).agg(F.sum("c").alias("a"))
    b = pairs.groupBy(F.col(two).alias("k")).agg(F.sum("c").alias("b"))
    chance = a.join(b, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    seen, luck = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") == 0, 0.0).when(luck >= 1.0, F.when(seen >= 1.0, 1.0).otherwise(0.0)).otherwise((seen - luck) / (1 - luck))
    return total.crossJoin(chance).select("n", kappa.alias("kappa"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """n / (k * count) per class, 1 for an empty one."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(i, x) for i, x in enumerate(("neg", "neu", "pos"))], "position int, label string")
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("c"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counted, "label", "left").crossJoin(total).select("position", "label", F.coalesce(F.try_divide("n", F.lit(3) * F.col("c")), F.lit(1.0)).alias("weight"))


def grid() -> Column:
    """The 17 thresholds 0.100 .. 0.500."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.round(F.lit(0.10) + F.lit(0.025) * i, 3)))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """Metrics at each threshold; rows have gold and p_pos, p_neu, p_neg."""
    at = rows.withColumn("threshold", grid())
    return metrics(at.withColumn("pred", apply_threshold(F.col("p_pos"), F.col("p_neu"), F.col("p_neg"), F.col("threshold"))), "threshold")


def best_threshold(curve: DataFrame, objective: str = "macro_f1") -> DataFrame:
    """The best threshold; ties go to the larger."""
    return curve.agg(F.max(F.struct(F.round(objective, 12).alias("m"), F.col("threshold"))).alias("b")).select("b.threshold", F.col("b.m").alias(objective))
