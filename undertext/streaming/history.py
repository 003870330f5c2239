"""The history of verdicts as a sink: newest entries alone, written once a batch, cleared at will, and read again as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertext.operators.reports import ENTRIES

ENTRY = "doc_id long, name string, file_type string, verdict string, layer string, payload string, ts long"


def _newest(df: DataFrame, *more: str) -> DataFrame:
    return df.orderBy(F.desc("ts"), *[F.desc(c) for c in more], F.desc("doc_id")).limit(ENTRIES)


class History:
    """A folder with a table of entries, a partition for each batch, and one of clearings.

    The table holds each batch's own newest entries, `ENTRIES` at most, so it is small however much the batches hold. A
    batch whose files are complete is not written again, so a batch repeated after a failure changes nothing.
    Batches none of whose entries is among the newest any more are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.entries, self.clearings = spark, f"{folder}/entries", f"{folder}/clearings"

    def _path(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _there(self, path: str) -> bool:
        files, at = self._path(path)
        return files.exists(at)

    def append(self, reports: DataFrame, batch: int) -> None:
        """Adds entries (of `ENTRY`) as batch; for use in foreachBatch. Nothing happens if the batch is there already, or was and is out of date."""
        place = f"{self.entries}/batch={batch}"
        if self._there(f"{place}/_SUCCESS") or batch <= self._forgotten():
            return
        _newest(reports.select(*[c.split()[0] for c in ENTRY.split(", ")])).coalesce(1).write.mode("overwrite").parquet(place)
        self._trim(batch)

    def _forgotten(self) -> int:
        return self.spark.read.schema("batch long").parquet(self.clearings).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] if self._there(self.clearings) else -1

    def _batches(self) -> list[int]:
        if not self._there(self.entries):
            return []
        files, at = self._path(self.entries)
        return sorted(int(name.split("=")[1]) for s in files.listStatus(at) if (name := s.getPath().getName()).startswith("batch="))

    def _trim(self, batch: int) -> None:
        kept = {r.batch for r in self.current(with_batch=True).select("batch").distinct().collect()}  # ENTRIES rows at most
        for old in self._batches():
            if old < batch and old not in kept:
                files, at = self._path(f"{self.entries}/batch={old}")
                files.delete(at, True)

    def clear(self) -> None:
        """Forgets all entries up to now. What a later batch adds stays."""
        if batches := self._batches():
            self.spark.createDataFrame([(batches[-1],)], "batch long").coalesce(1).write.mode("append").parquet(self.clearings)

    def current(self, with_batch: bool = False) -> DataFrame:
        """The newest entries, newest first; of equal times, those of the later batch and then those with the larger id are newer."""
        if not self._there(self.entries):
            return self.spark.createDataFrame([], ENTRY + (", batch long" if with_batch else ""))
        rows = self.spark.read.schema(ENTRY + ", batch long").parquet(self.entries).where(F.col("batch") > self._forgotten())
        found = _newest(rows, "batch")
        return found if with_batch else found.drop("batch")

    def changes(self) -> DataFrame:
        """The entries as a stream, as batches add them."""
        files, at = self._path(self.entries)
        files.mkdirs(at)
        return self.spark.readStream.schema(ENTRY + ", batch long").option("ignoreMissingFiles", "true").parquet(self.entries)


def kept(reports: DataFrame, history: History, checkpoint: str):
    """A query that adds a stream of reports (of `ENTRY`) to the history."""
    return reports.writeStream.foreachBatch(lambda df, batch: history.append(df, batch)).option("checkpointLocation", checkpoint)
