"""Positions within groups without gathering a group in one task.

A row's bucket is a prefix of its order; buckets are counted, the counts are summed up in order, and only the rows of one
bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a digest, and positions, that make a bucket.
DIGITS, SPAN = 3, 1 << 16


def hash_order(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _counts(rows: DataFrame, groups: list[str], bucket: Column) -> DataFrame:
    """Each group's buckets, with their rows and the group's rows before them."""
    named = [f"_g{i}" for i in range(len(groups))]
    counts = rows.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, named, strict=True)], bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*named).orderBy("_b")) - F.col("_n"))


def _placed(rows: DataFrame, groups: list[str], bucket: Column, order: list, name: str, counts: DataFrame | None = None) -> DataFrame:
    held = rows.withColumn("_bucket", bucket)
    counts = (_counts(rows, groups, bucket) if counts is None else counts).drop("_n")
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order))
    joined = held.join(counts, same).withColumn(name, F.col("_before") + inside)
    return joined.drop("_bucket", "_b", "_before", *[f"_g{i}" for i in range(len(groups))])


def hash_bucket(seed: int, key: str = "id") -> Column:
    return F.substring(hash_order(seed, key), 1, DIGITS)


def hash_counts(rows: DataFrame, groups: list[str], seed: int, key: str = "id") -> DataFrame:
    """The counts behind ``hash_rank``: groups as _g0, _g1, ..., bucket _b, its rows _n, the group's rows before it _before."""
    return _counts(rows, groups, hash_bucket(seed, key))


def hash_rank(rows: DataFrame, groups: list[str], seed: int = 42, key: str = "id", name: str = "_rank", counts: DataFrame | None = None) -> DataFrame:
    """Add the position (from 1) in seeded hash order within the group; ``counts`` where they are known, of whole buckets."""
    return _placed(rows, groups, hash_bucket(seed, key), [hash_order(seed, key), key], name, counts)


def number(rows: DataFrame, order: str, name: str = "_number") -> DataFrame:
    """Add the position (from 1) in the order of a whole-number column, whatever gaps it has."""
    return _placed(rows, [], F.floor(F.col(order) / SPAN), [order], name)


def group_sizes(rows: DataFrame, *groups: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
