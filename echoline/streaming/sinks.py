"""A file sink that holds each micro-batch once, however often the batch is written again after a failure.

A batch is written aside and made ready by one rename of its folder; only then do its files move into the table, under
names that carry the batch.  A repeated batch that is ready only moves what is left, one that is done is skipped.  Folders
that start with an underscore are not read, so the table stays a plain Parquet folder.  The file system must rename
folders in one step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """Paths below one table folder, on whatever file system Spark sees there."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def there(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(*parts))) if self.there(*parts) else []

    def move(self, source: list[str], target: list[str]) -> None:
        self.fs.mkdirs(self.path(*target).getParent())
        if not self.fs.rename(self.path(*source), self.path(*target)):
            raise OSError(f"{'/'.join(source)} could not become {'/'.join(target)}")

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)

    def write_text(self, text: str, *parts: str) -> None:
        """The whole text or nothing: written aside, then renamed."""
        aside = f"_aside-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(aside), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move([aside], list(parts))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that a query keeps over restarts from its checkpoint; another checkpoint has another."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def write_once(rows: DataFrame, path: str, stream: str, number: int) -> bool:
    """Add the rows of a stream's micro-batch to the table folder; False where an earlier attempt had done so."""
    folder, batch = Folder(rows.sparkSession, path), f"{stream}-{number:012d}"
    if folder.there("_done", batch):
        return False
    first = not folder.there("_ready", batch)
    if first:
        folder.drop("_pending", batch)
        rows.write.parquet("/".join([folder.root, "_pending", batch]))
        folder.move(["_pending", batch], ["_ready", batch])
    for name in folder.names("_ready", batch):
        if name.startswith("part-"):
            folder.move(["_ready", batch, name], [f"{batch}-{name}"])
    folder.write_text("", "_done", batch)
    folder.drop("_ready", batch)
    return first
