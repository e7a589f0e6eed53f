"""Shared helpers: tables, durable intermediate results, row keys, size-checked broadcasts, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many narrow rows (a few numbers each, some 10 MB in all) are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 300_000

#: Rows in an Arrow batch while a table is written; whole texts are in them, so that Python workers stay small.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session has none (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="echoline-"))
        chosen = spark.sparkContext.getCheckpointDir()
    return chosen.rstrip("/")


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files that outlive executors."""
    return Scratch(df.sparkSession).keep(df, codec)


class Scratch:
    """Intermediate tables of one operator in the shared folder, deleted when nothing reads them any more.

    ``keep`` writes a table and reads it back; ``drop`` deletes some of them, ``clear`` all but the named ones.  Only
    tables whose readers have been written themselves may go, so a lost executor never needs a deleted file.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        path = f"{shared_dir(self.spark)}/llm-{uuid.uuid4().hex}"
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(ARROW_ROWS))
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(name, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(frame))[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, *but: DataFrame) -> None:
        self.drop(*[frame for _, frame in list(self.paths.values()) if not any(frame is x for x in but)])
        self.release()

    def release(self) -> None:
        """Let Spark remove the shuffle files and broadcasts of what has ended.

        It does so when the driver's garbage is collected, which a driver with little to do hardly ever does; after a
        phase of many jobs it is asked to, so executors' disks hold one phase's files.
        """
        gc.collect()
        self.spark._jvm.System.gc()


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit("text"), text)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast where its row count, checked here, allows; for written tables of a few numbers a row."""
    return F.broadcast(df) if df.count() <= rows else df


def repeated_rows(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc_id, t) of the ids (null among them) and texts that several rows have; texts are only read where ids repeat."""
    own = column(id_col).cast("long").alias("doc_id")
    several = scratch.keep(docs.select(own).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("k")))
    slim = docs.select(own, text_hash(column(text_col)).alias("t")).join(bounded(several), F.col("doc_id").eqNullSafe(F.col("k")), "left_semi")
    return scratch.keep(slim.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "t"))


def mark_again(docs: DataFrame, repeated: DataFrame, name: str, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``docs`` with a boolean column ``name``: false for one of the rows of each id and text, true for the others.

    ``repeated`` (doc_id, t) lists the ids and text hashes that several rows have; only such rows are written, numbered
    and compared with the least number of their kind.
    """
    if repeated.isEmpty():
        return docs.withColumn(name, F.lit(False))
    row, one, key, mark = unused(docs, "row", "one", "key_id", "key_text")
    listed = bounded(repeated.select(F.col("doc_id").alias(key), F.col("t").alias(mark)))
    same = column(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash(column(text_col)) == F.col(mark))
    rest = docs.join(listed, same, "left_anti").withColumn(name, F.lit(False))
    several = scratch.keep(docs.join(listed, same).withColumn(row, F.monotonically_increasing_id()))
    first = several.groupBy(key, mark).agg(F.min(row).alias(one)).select(F.col(one).alias(row), F.lit(True).alias(one))
    several = several.join(bounded(first), row, "left").withColumn(name, F.col(one).isNull())
    return rest.unionByName(several.select(*map(column, rest.columns)))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps; every round's edge set is written to the shared folder, so the
    lineage stays short, and the round before is deleted.  Only minima per node are aggregated (map-side combine),
    neighbour lists are never built; the join that hands a hub's minimum to its neighbours is a plain shuffle join,
    whose large partitions adaptive execution splits.  Self-loops and null ends are ignored.  The number of rounds is
    about the logarithm of the longest path; ``max_rounds`` only guards against a fault and raises.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    count, before = pairs.count(), None
    for _ in range(max_rounds if count else 0):
        # both minima tables have at most as many rows as there are ends of edges
        small_enough = F.broadcast if 2 * count <= BROADCAST_ROWS else lambda df: df
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(small_enough(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_enough(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        told = Observation()  # counted while it is written; there are edges, so it is never empty
        following = scratch.keep(small.union(least.select("u", "m")).distinct().observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")))
        scratch.drop(pairs)
        pairs, after = following, (told.get["n"], told.get["digest"])
        if after == before:
            break
        count, before = after[0], after
    else:
        if count:
            raise RuntimeError("components did not settle")
    return pairs.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("node"), F.col("c").alias("component")).union(
        pairs.select("v", "v").distinct()
    )
