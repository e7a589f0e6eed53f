"""A stored table with one row per key that merges change in place of copying: parts, buckets, versions.

Rows lie in ``parts`` folders by a hash of the key, and inside each in ``buckets`` sorted files by Spark's own bucket hash.
A merge finds the parts that the source's keys fall into, reads only those, joins them to the source bucket by bucket (the
target's side needs no exchange), and writes them aside as a new version.  The other parts keep their files.  A version is a
manifest that names each part's folder; it is written last, in one step, so a merge that fails leaves the version before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.sinks import Folder
from .merge import latest


class StoredTable:
    """``StoredTable.create(empty rows, path)``, then ``merge`` and ``read``; opening an old ``version`` reads it as it was."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.folder = spark, Folder(spark, path)
        self.version = version if version is not None else max(int(n.split(".")[0]) for n in self.folder.names("_versions"))
        held = json.loads("\n".join(r[0] for r in spark.read.text(f"{self.folder.root}/_versions/{self._name(self.version)}").collect()))
        self.key, self.parts, self.buckets, self.schema, self.folders = held["key"], held["parts"], held["buckets"], held["schema"], held["folders"]

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:09d}.json"

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", parts: int = 64, buckets: int | None = None) -> StoredTable:
        """An empty table with the rows' columns; raises where there is one.

        A merge runs one task a bucket, which writes a file into each touched part: ``buckets`` is the session's number of
        shuffle partitions where none is given.
        """
        folder = Folder(rows.sparkSession, path)
        if folder.names("_versions"):
            raise RuntimeError(f"{path} holds a table")
        buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = {"key": key, "parts": parts, "buckets": buckets, "schema": ", ".join(f"`{n}` {t}" for n, t in rows.dtypes), "folders": {}}
        folder.write_text(json.dumps(held), "_versions", cls._name(0))
        return cls(rows.sparkSession, path)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int")

    def _table(self, parts: list[int]) -> DataFrame:
        """The given parts as a bucketed table, from a catalog entry that lists this version's folders; it holds no data."""
        name = f"stored_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({self.schema}, _part INT) USING parquet PARTITIONED BY (_part) "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.folder.root}/_none'"
        )
        held = [(p, self.folders[str(p)]) for p in parts if str(p) in self.folders]
        for at in range(0, len(held), 200):
            self.spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (_part={p}) LOCATION '{self.folder.root}/{f}'" for p, f in held[at : at + 200]))
        return self.spark.table(name)

    def read(self) -> DataFrame:
        return self._table(list(range(self.parts))).drop("_part")

    def plan(self, source: DataFrame, freshness: str) -> tuple[DataFrame, list[int]]:
        """The touched parts after the merge, with merge_action, and their numbers (at most ``parts`` on the driver)."""
        given = source.where(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in given.select(self._part().alias("p")).distinct().collect())
        fresh = latest(given.repartition(self.buckets, self.key), freshness, self.key)  # the only exchange of whole rows
        t, s = self._table(touched).drop("_part").alias("t"), fresh.alias("s")
        both = t.join(s, F.col(f"t.{self.key}") == F.col(f"s.{self.key}"), "full_outer")
        new = F.col(f"t.{self.key}").isNull()
        take = new | F.coalesce(F.col(f"s.{freshness}") > F.col(f"t.{freshness}"), F.lit(False))
        action = F.when(new, "inserted").when(take, "updated").otherwise("kept")
        return both.select(*[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in t.columns], action.alias("merge_action")), touched

    def merge(self, source: DataFrame, freshness: str) -> StoredTable:
        """The table after MERGE: newer rows replace strictly older ones, new keys are added; null keys are left out.

        One writer at a time: where another version has come meanwhile, this one raises and changes nothing.
        """
        rows, touched = self.plan(source, freshness)
        if not touched:
            return self
        home, name = f"data/{self.version + 1:09d}-{uuid.uuid4().hex}", f"stored_{uuid.uuid4().hex}"
        writer = rows.drop("merge_action").withColumn("_part", self._part()).write.format("parquet").partitionBy("_part")
        writer.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.folder.root}/{home}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: its files stay
        folders = self.folders | {str(p): f"{home}/_part={p}" for p in touched}
        held = {"key": self.key, "parts": self.parts, "buckets": self.buckets, "schema": self.schema, "folders": folders}
        if self.folder.there("_versions", self._name(self.version + 1)):
            raise RuntimeError("another merge has come first")
        self.folder.write_text(json.dumps(held), "_versions", self._name(self.version + 1))
        return StoredTable(self.spark, self.folder.root)
