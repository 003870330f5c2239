"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: What lies between words made of ASCII letters and digits and of everything beyond ASCII.
GAP_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is. Pure ASCII goes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_split(text: Column) -> Column:
    """Words between white space; null and blank text have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def gap_split(text: Column) -> Column:
    """Lower-cased words between ASCII characters that are neither letters nor digits; null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP_RUN), "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a cluster, whose executors would not share it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="undertext-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/undertext-{uuid.uuid4().hex}"


#: Bytes of rows that a worker gets in one Arrow batch, one row at least. By number of rows alone a task's whole share of
#: texts is one batch, which the executor and the worker hold several times over.
BATCH = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions within send workers batches of BATCH bytes, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None) is None
    if own:
        spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(key)


def stored(df: DataFrame, folder: str, *by: str) -> DataFrame:
    """df as a written table in a shared folder: lineage ends here, and a lost executor costs nothing before it."""
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """df marked for broadcast where its counted rows are within the bound; else Spark shuffles the join."""
    return F.broadcast(df) if rows <= bound else df


#: What names a row of documents together with its doc_id.
NAME = ("doc_id", "h", "h2")
#: Names of rows are broadcast up to this many (about 50 bytes each), else joined by shuffle.
FEW = 1_000_000


def named_rows(docs: DataFrame, by: tuple[str, ...], *more: str | Column) -> DataFrame:
    """(doc_id, h, h2) and more of every row. h and h2 are two hashes of the columns in by, so 128 bits tell texts apart."""
    told = [x for c in by for x in (F.col(c), F.col(c).isNull())]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*told).alias("h"), F.xxhash64(F.lit(2), *told).alias("h2"), *more)


def matching(rows: DataFrame, names: DataFrame, count: int, how: str) -> DataFrame:
    """rows joined (left_anti or left_semi) with names, both with (doc_id, h, h2); count: how many names there are."""
    side = broadcast_if_small(names.select(*[F.col(c).alias(f"g_{c}") for c in NAME]), count, FEW)
    return rows.join(side, (F.col("h") == F.col("g_h")) & (F.col("h2") == F.col("g_h2")) & F.col("doc_id").eqNullSafe(F.col("g_doc_id")), how)


def without(docs: DataFrame, by: tuple[str, ...], names: DataFrame, folder: str) -> DataFrame:
    """docs, with all their columns, but for the rows that names has. The names are written to folder, not the rows."""
    gone = stored(names.select(*NAME).distinct(), folder)
    return matching(named_rows(docs, by, F.struct("*").alias("row")), gone, gone.count(), "left_anti").select("row.*")


def free_memory() -> None:
    """Gives memory that this process has freed back to the system; for the ends of tasks, as workers wait for others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of written tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
