"""Sliding windows over late and revised hours with Structured Streaming (TMP-05, TMP-07..09).

A window aggregate in append mode cannot take back an hour that a better source revises.  So the state is the table of
hours itself: each micro-batch upserts (cell, hour, value, priority), a better source or a later arrival of the same
source wins, hours past retention go, and windows are computed from the hours that changed and those before them.

The state lies in blocks of hours.  A batch reads and writes only the blocks that it has rows for; the manifest of a
version names the folder of every block.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.weather import trailing

HOUR = "cell string, hour timestamp, value double, priority int, seq long"


def best_hours(rows: DataFrame) -> DataFrame:
    """Of all rows of a cell and hour, the lowest priority number, then the latest sequence number."""
    return rows.groupBy("cell", "hour").agg(F.min_by(F.struct("value", "priority", "seq"), F.struct("priority", -F.col("seq"))).alias("x")).select("cell", "hour", "x.*")


class Revisions:
    """foreachBatch sink that keeps the best value per cell and hour in Parquet blocks of `block_hours`.

    A version is the micro-batch that made it.  Its blocks are written to folders of its own, then its manifest, in one
    rename; a rerun of a batch starts from the version before it and writes the same.  A new sink on the same path goes
    on from the last manifest.  Versions but the last `keep_versions`, and folders that none of them names, are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keep_hours: int | None = None, block_hours: int = 24, keep_versions: int = 2):
        self.spark, self.path, self.keep_hours, self.block_hours, self.keep_versions = spark, path.rstrip("/"), keep_hours, block_hours, keep_versions
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version = max(self.versions(), default=-1)
        self.touched: list[int] = []

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The versions that have a manifest."""
        home = self._path("versions")
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(home) if f.getPath().getName().isdigit()) if self.files.exists(home) else []

    def manifest(self, version: int) -> dict[int, str]:
        """Block number -> folder."""
        if version < 0:
            return {}
        stream = self.files.open(self._path(f"versions/{version}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def _publish(self, version: int, blocks: dict[int, str]) -> None:
        part = self._path(f"versions/.{version}")
        out = self.files.create(part, True)
        try:
            out.write(bytearray(json.dumps(blocks).encode()))
        finally:
            out.close()
        self.files.delete(self._path(f"versions/{version}"), False)
        self.files.rename(part, self._path(f"versions/{version}"))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], HOUR)
        return self.spark.read.schema(HOUR).parquet(*[f"{self.path}/{f}" for f in folders])

    def _block(self, hour: str) -> Column:
        return F.floor(F.unix_timestamp(hour) / (3600 * self.block_hours)).cast("long")

    def current(self, since: int | None = None) -> DataFrame:
        """The hours of the last version; of blocks from `since` on if given."""
        return self._read([f for b, f in self.manifest(self.version).items() if since is None or b >= since])

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        before = self.manifest(max([v for v in self.versions() if v < epoch], default=-1))
        rows = batch.select("cell", "hour", "value", "priority", "seq")
        touched = sorted(r[0] for r in rows.select(self._block("hour").alias("b")).distinct().collect())  # blocks of the batch's hours
        if touched:
            merged = best_hours(self._read([before[b] for b in touched if b in before]).unionByName(rows))
            home = f"blocks/{epoch}"
            merged.withColumn("block", self._block("hour")).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{self.path}/{home}")
            before = before | {b: f"{home}/block={b}" for b in touched}
        if self.keep_hours is not None and before:
            last = max(before)
            newest = self._read([before[last]]).agg(F.max(F.unix_timestamp("hour"))).first()[0]
            before = {b: f for b, f in before.items() if (b + 1) * self.block_hours * 3600 > newest - self.keep_hours * 3600}
        self._publish(epoch, before)
        self.version, self.touched = epoch, touched
        self._prune()

    def _prune(self) -> None:
        versions = self.versions()
        for v in versions[: -self.keep_versions]:
            self.files.delete(self._path(f"versions/{v}"), False)
        named = {f.split("/")[1] for v in versions[-self.keep_versions :] for f in self.manifest(v).values()}
        home = self._path("blocks")
        for f in self.files.listStatus(home) if self.files.exists(home) else []:
            if f.getPath().getName() not in named and int(f.getPath().getName()) < self.version:
                self.files.delete(f.getPath(), True)

    def windows(self, hours: tuple[int, ...], changed_only: bool = False) -> DataFrame:
        """Trailing windows of all hours; with changed_only of those that the last batch can have changed: from its first block on."""
        kept = self.current()
        if self.keep_hours is not None and self.version >= 0:
            last = kept.agg(F.max("hour")).first()[0]
            kept = kept.where(F.col("hour") > F.lit(last) - F.expr(f"interval {self.keep_hours} hours")) if last is not None else kept
        if not changed_only or not self.touched:
            return trailing(kept, ["cell"], hours)
        start = min(self.touched) * self.block_hours * 3600
        kept = kept.where(F.unix_timestamp("hour") > start - max(hours) * 3600)
        return trailing(kept, ["cell"], hours).where(F.unix_timestamp("hour") >= start)


def run_available(stream: DataFrame, sink: Revisions, checkpoint: str) -> None:
    """TMP-08: takes what is new and stops; without new data no batch runs."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(stream: DataFrame, time: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """TMP-03: hourly sums with a watermark, for sources that are never revised."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), key).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return w.select(F.col("window.start").alias("hour"), key, "total", "n")


__all__ = ["Revisions", "best_hours", "run_available", "tumbling"]
