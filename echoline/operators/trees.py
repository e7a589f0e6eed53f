"""Reply trees from flat (id, parent) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reply_depths(roots: DataFrame, replies: DataFrame, max_depth: int = 2, root_id: str = "id", id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The replies below the roots down to ``max_depth`` (0: answers to a root), with ``root`` and ``depth``.

    One join per level, on the exchange of the replies by parent that all levels share; a level carries only ids.
    A reply whose parent is missing, null or deeper than asked for is left out, and so are replies that answer each
    other or themselves in a circle: no root leads there.  Where an id repeats, its rows all stay, and answers to it
    are listed once, below its uppermost place.
    """
    level = roots.where(F.col(root_id).isNotNull()).select(F.col(root_id).alias("_above"), F.col(root_id).alias("root")).groupBy("_above").agg(F.min("root").alias("root"))
    ids = replies.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_above"))
    levels, seen = [], level.select(F.col("_above").alias("_id"))
    for depth in range(max_depth + 1):
        found = ids.join(level, "_above").groupBy("_id", "_above").agg(F.min("root").alias("root"))
        levels.append(found.withColumn("depth", F.lit(depth)))
        level = found.groupBy("_id").agg(F.min("root").alias("root")).join(seen, "_id", "left_anti")
        seen = seen.union(level.select("_id"))
        level = level.select(F.col("_id").alias("_above"), "root")
    placed = reduce(DataFrame.unionByName, levels)
    first = placed.groupBy("_id", "_above").agg(F.min(F.struct("depth", "root")).alias("_at"))
    joined = replies.join(first, (F.col(id_col) == F.col("_id")) & (F.col(parent_col) == F.col("_above")))
    return joined.select(*[replies[c] for c in replies.columns], F.col("_at.root").alias("root"), F.col("_at.depth").alias("depth"))
