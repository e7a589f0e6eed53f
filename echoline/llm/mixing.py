"""Mix sources to target weights by subset-sum budget fitting.

Sizes are exact token counts.  Per source, documents are counted by size; whole copies cover the integer part of
``target / source size``; the remaining budget is met by a proportional floor over the size counts, a greedy fill and
a bounded-knapsack dynamic program over what is left.  Which documents of a size are taken is decided by a seeded hash.

Defined results: a null text has size 0; size-0 documents are never taken (taken = 0); a null source is a source of
its own, last in order; repeated rows, null ids and several texts of one id are separate documents; texts of any length
are counted whole; an empty table gives an empty result; extra columns are ignored by ``mix_plan`` and pass through
``mix``, whatever their names.  Nothing is sampled or capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, column, materialize, text_hash, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Leading bits of the hash by which the documents of one (source, size) are dealt, so that a hot size is no single task.
RANGE_BITS = 8
#: Words left for the dynamic program.
WINDOW = 32768


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size to take (0..counts) so that their words sum to ``budget`` or just below."""
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    take[sizes <= 0] = 0
    rest = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if rest <= window:
            break
        s = int(sizes[i])
        if s <= 0:
            continue
        n = min(int(counts[i] - take[i]), (rest - window) // s)
        if n > 0:
            take[i] += n
            rest -= n * s
    return take + _knapsack(sizes, counts - take, rest, order)


def _knapsack(sizes: np.ndarray, left: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Bounded knapsack: the largest reachable sum up to ``budget``; first-reached choices allow the walk back."""
    extra = np.zeros(len(sizes), dtype=np.int64)
    reach = np.zeros(budget + 1, dtype=bool)
    reach[0] = True
    item = np.full(budget + 1, -1, dtype=np.int64)
    used = np.zeros(budget + 1, dtype=np.int64)
    for i in order:
        s, c = int(sizes[i]), int(left[i])
        if s <= 0 or c <= 0 or s > budget:
            continue
        before = reach.copy()
        for k in range(1, min(c, budget // s) + 1):
            new = before[: budget + 1 - k * s] & ~reach[k * s :]
            if not new.any():
                continue
            at = np.flatnonzero(new) + k * s
            reach[at] = True
            item[at] = i
            used[at] = k
            if reach[budget]:
                break
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = int(item[at]), int(used[at])
        extra[i] += k
        at -= k * int(sizes[i])
    return extra


def source_targets(sources: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by weight, none above ``cap`` times its size.

    The excess of capped sources is dealt again by weight until nothing changes.  Each round aggregates two scalars;
    the table of sources stays distributed.
    """
    ranked = _ranked(sources).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    ranked = materialize(ranked)
    full = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * full, -1.0
    limit = F.col("source_size") * F.lit(float(cap))
    while True:
        capped = limit <= F.col("weight") * F.lit(level)
        fixed, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        following = (budget - fixed) / open_weight if open_weight else level
        if not open_weight or following <= level:
            break
        level = following
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(max(level, 0.0))).alias("target"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Position from 0 in code-point order of source, null last, without gathering all sources in one task."""
    ordered = materialize(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
    )
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    start = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        ordered.withColumn("inside", F.row_number().over(inside) - 1)
        .join(start, "part")
        .select("source", "source_size", (F.col("start") + F.col("inside")).alias("rank"))
    )


GROUP = ["no_source", "source_key", "size"]


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """The columns by which a row is counted and chosen."""
    source, digest = column(source_col).cast("string"), text_hash(column(text_col))
    return {
        "no_source": source.isNull(), "source_key": F.coalesce(source, F.lit("")), "size": word_count(column(text_col)),
        "text_hash": digest, "hash": F.xxhash64(F.lit(seed), column(id_col).cast("string"), digest),
    }


def _placed(docs: DataFrame, scratch: Scratch, weights: tuple, share: float, cap: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every row's GROUP, hash, source_size, target, base and whether its place in hash order earns one copy more."""
    sized = _sized(docs, seed, id_col, text_col, source_col)
    slim = docs.select(column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), *[c.alias(n) for n, c in sized.items()])
    slim = scratch.keep(slim.withColumn("range", F.shiftright("hash", 64 - RANGE_BITS).cast("int")))
    counts = scratch.keep(slim.groupBy(*GROUP, "range").agg(F.count(F.lit(1)).alias("n")))
    by_size = counts.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    sources = by_size.groupBy("no_source", "source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")).select(
        F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "source_size"
    )
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    targets = source_targets(sources, weights, share, cap).select("*", *key).drop("source")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", kind="stable")
        size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        base = int(target // size) if size else 0
        more = fit_budget(frame["size"].to_numpy(), frame["n"].to_numpy(), int(round(target - base * size)))
        return frame.assign(base=base, more=more)

    chosen = (
        by_size.join(targets, ["no_source", "source_key"])
        .groupBy("no_source", "source_key")
        .applyInPandas(
            choose,
            "no_source boolean, source_key string, size long, n long, source_size long, target double, base long, more long",
        )
        .drop("n")
    )
    before = F.sum("n").over(Window.partitionBy(*GROUP).orderBy("range")) - F.col("n")
    dealt = (
        counts.join(chosen, GROUP)
        .withColumn("before", before)
        .withColumn("more", F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("n")))
        .drop("n", "before")
    )
    place = F.row_number().over(Window.partitionBy(*GROUP, "range").orderBy("hash", "doc_id"))
    return slim.join(dealt, [*GROUP, "range"]).withColumn("extra", (F.col("size") > 0) & (place <= F.col("more")))


def mix_plan(
    docs: DataFrame,
    *,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2,
    seed: int = 20_24,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (doc_id, text_hash, size, source, source_size, target, repeats, taken), one per row of ``docs``."""
    placed = _placed(docs, Scratch(docs.sparkSession), weights, share, cap, seed, id_col, text_col, source_col)
    repeats = F.when(F.col("size") > 0, F.col("base") + F.col("extra").cast("long")).otherwise(0)
    return placed.select("doc_id", "text_hash", "size", "source", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2,
    seed: int = 20_24,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as many times as the plan takes it, columns unchanged.

    The plan is folded to one row for each source and size, with the last hash that earns a copy more, so every row
    decides for itself and none is shuffled.  Only where rows of equal hash (equal id and text) stand at that bound, and
    some of them go, are these rows written and numbered.
    """
    scratch, names = Scratch(docs.sparkSession), docs.columns
    placed = scratch.keep(_placed(docs, scratch, weights, share, cap, seed, id_col, text_col, source_col).select(*GROUP, "hash", "base", "extra"))
    edges = placed.groupBy(*GROUP).agg(F.max("base").alias("base"), F.max(F.when(F.col("extra"), F.col("hash"))).alias("last"), F.min(F.when(~F.col("extra"), F.col("hash"))).alias("next"))
    edges = scratch.keep(edges.withColumn("tied", F.coalesce(F.col("last") == F.col("next"), F.lit(False))).drop("next"))
    tied = edges.where("tied").select(*GROUP, F.col("last").alias("hash"))
    ties = scratch.keep(placed.join(bounded(tied), [*GROUP, "hash"]).groupBy(*GROUP, "hash").agg(F.count_if("extra").alias("earn")))
    own = dict(zip([*GROUP, "text_hash", "hash"], unused(docs, *GROUP, "text_hash", "hash"), strict=True))
    base, last, tie, row, earn, copy = unused(docs.withColumns({n: F.lit(0) for n in own.values()}), "base", "last", "tied", "row", "earn", "copy")
    keyed = docs.withColumns({own[n]: c for n, c in _sized(docs, seed, id_col, text_col, source_col).items()})
    told = edges.select(*[F.col(n).alias(own[n]) for n in GROUP], F.col("base").alias(base), F.col("last").alias(last), F.col("tied").alias(tie))
    joined = keyed.join(bounded(told), [own[n] for n in GROUP]).where(F.col(own["size"]) > 0)
    extra = F.coalesce(F.col(own["hash"]) <= F.col(last), F.lit(False))
    at_bound = F.col(tie) & (F.col(own["hash"]) == F.col(last))
    out = joined.where(~F.coalesce(at_bound, F.lit(False))).withColumn(copy, F.col(base) + extra.cast("long"))
    if not ties.isEmpty():
        several = scratch.keep(joined.where(at_bound).withColumn(row, F.monotonically_increasing_id()))
        number = F.row_number().over(Window.partitionBy(*[own[n] for n in [*GROUP, "hash"]]).orderBy(row))
        several = several.withColumn(row, number).join(ties.select(*[F.col(n).alias(own[n]) for n in [*GROUP, "hash"]], F.col("earn").alias(earn)), [own[n] for n in [*GROUP, "hash"]])
        several = several.withColumn(copy, F.col(base) + (F.col(row) <= F.col(earn)).cast("long"))
        out = out.select(*map(column, [*names, copy])).unionByName(several.select(*map(column, [*names, copy])))
    out = out.where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
    return out.select(*map(column, names))
