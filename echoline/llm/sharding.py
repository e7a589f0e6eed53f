"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 128-bit key hash.  One bucket holds everything at first; only buckets
over the byte limit split, on the next bit, until each fits.  A bucket of a single row that is larger than the limit
cannot split and stays, flagged ``oversize``.

The splits are found on byte totals by prefix: each round sums the rows of unresolved buckets at ``STEP`` further
bits (map-side combined), so no bucket's rows are gathered in a task, and only rows of unresolved buckets are read again.

Defined results: null text is 0 bytes; null and repeated ids are ordinary keys (the second half of the hash tells
repeated rows apart, by the row's place); rows of any size are one number of bytes here; an empty table gives no shard;
extra columns pass through ``assign`` untouched, and where one has the name of a result column, that gets a ``_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, unused

STEP = 12
DEPTH = 120


def key_bits(df: DataFrame, id_col: str, name: str = "_bits") -> DataFrame:
    """Add 120 binary digits, 60 from the id's md5, 60 from a number that only tells equal ids apart."""
    binary = lambda c: F.lpad(F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 2), 60, "0")
    first = F.coalesce(column(id_col).cast("string"), F.lit("null"))
    return df.withColumn(name, F.concat(binary(first), binary(F.monotonically_increasing_id())))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Buckets (shard, depth, shard_bytes, shard_rows, oversize) of ``sized`` (_bits, n_bytes)."""
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1)
    rest, found, above, depth = sized, None, None, 0
    while True:
        deeper = min(depth + STEP, DEPTH)
        cells = rest.groupBy(F.substring("_bits", 1, deeper).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")
        )
        levels = F.sequence(F.lit(depth + (depth > 0)), F.lit(deeper))
        buckets = materialize(
            cells.withColumn("depth", F.explode(levels))
            .groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard"))
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        )
        split = buckets.where(~fits).select(F.col("shard").alias("parent"))
        parents = split if above is None else split.union(above)
        last = F.lit(deeper == DEPTH) & (F.col("depth") == deeper)
        leaves = buckets.where("depth > 0").where(fits | last).join(parents, F.expr("substring(shard, 1, depth - 1) = parent"), "left_semi")
        if depth == 0:
            leaves = leaves.unionByName(buckets.where("depth = 0").where(fits))
        found = leaves if found is None else found.unionByName(leaves)
        above = buckets.where(~fits).where(F.col("depth") == deeper).select(F.col("shard").alias("parent"))
        if deeper == DEPTH or above.isEmpty():
            return found.withColumn("oversize", F.col("shard_bytes") > limit)
        rest = rest.join(above, F.substring("_bits", 1, deeper) == F.col("parent"), "left_semi")
        depth = deeper


def assign(df: DataFrame, *, limit: int, id_col: str = "doc_id", bytes_col: str = "n_bytes") -> DataFrame:
    """``df`` (id, bytes, ...) with shard, depth, shard_bytes, oversize of each row."""
    (bits,) = unused(df, "bits")
    return _place(materialize(key_bits(df, id_col, bits)), bits, limit, bytes_col).drop(bits)


def _place(keyed: DataFrame, bits: str, limit: int, bytes_col: str) -> DataFrame:
    """``keyed`` rows, which lie in a written table, with their shards."""
    given = ["shard", "depth", "shard_bytes", "oversize"]
    probe, *names = unused(keyed.drop(bits), "probe", *given)
    shards = materialize(directory(keyed.select(F.col(bits).alias("_bits"), column(bytes_col).alias("n_bytes")), limit))
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most 121 numbers
    kinds = {"shard": "string", "depth": "int", "shard_bytes": "long", "oversize": "boolean"}
    if not depths:
        return keyed.withColumns({n: F.lit(None).cast(kinds[g]) for n, g in zip(names, given, strict=True)})
    probes = F.explode(F.array(*[F.substring(bits, 1, d) for d in sorted(depths)]))
    listed = shards.select(*[F.col(g).alias(n) for n, g in zip(names, given, strict=True)])
    return keyed.withColumn(probe, probes).join(listed, F.col(probe) == F.col(names[0])).drop(probe)


def write_shards(docs: DataFrame, path: str, *, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows as one folder per shard; a shard is within the limit, so it is one task's work.

    Rows find their shards by keys and sizes alone; texts are joined to them once, and dealt to their shards once.
    Folders are named ``b`` and the prefix: bare digits would be read back as numbers, and prefixes of zeros as one.
    """
    bits, shard = unused(docs, "bits", "shard")
    keyed = materialize(key_bits(docs, id_col, bits))
    sized = keyed.select(bits, F.coalesce(F.octet_length(column(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    found = _place(sized, bits, limit, "n_bytes").select(bits, F.col("shard").alias(shard))
    keyed.join(found, bits).repartition(shard).select(*map(column, docs.columns), F.concat(F.lit("b"), shard).alias(shard)).write.partitionBy(shard).parquet(path)
