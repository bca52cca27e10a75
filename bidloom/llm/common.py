"""Helpers shared by the training-data operators: lineage cuts, size-checked joins, Arrow streaming, packed messages."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the operator contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where that is unset, a temporary one, which only a local master can use."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="bidloom-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settle(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def attach(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left", rows: int = 50_000) -> DataFrame:
    """Joins a settled side to a large one: broadcast only if it has been counted and holds at most `rows` rows, else a shuffled join whose skewed partitions AQE splits."""
    return big.join(F.broadcast(small) if small.limit(rows + 1).count() <= rows else small, on, how)


def rekeyed(rows: DataFrame, clash: DataFrame | None, key: str = "node", check: str = "high") -> DataFrame:
    """The rows with other keys where `clash` (see apart) says so."""
    if clash is None:
        return rows
    other = F.col("__low").isNotNull() & (F.col(check) != F.col("__low"))
    return rows.join(F.broadcast(clash), key, "left").withColumn(key, F.when(other, F.xxhash64(key, check)).otherwise(F.col(key))).drop("__low")


def apart(rows: DataFrame, key: str = "node", check: str = "high") -> DataFrame | None:
    """Keys that rows with different checks share, with the check that keeps the key; None if there are none, as nearly always.

    After rekeyed, rows share a key only if both 64-bit hashes, key and check, are equal."""
    clash = settle(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(check).alias("__low"), F.max(check).alias("__top")).filter("__low != __top").select(key, "__low"))
    return clash if clash.limit(1).count() else None


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For functions of mapInArrow: when a task ends, its memory goes back to the system, since Spark keeps the worker for later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        trimmed()

    return tidied


def trimmed() -> None:
    """Gives memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift-multiply finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_list(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of finished queries now, instead of when the driver happens to collect its garbage."""
    for _ in range(2):  # listeners hold a query for a moment after its end
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def fresh_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is there goes when the process ends."""
    path = f"{shared_dir(spark)}/bidloom-{uuid.uuid4().hex}"
    atexit.register(dropped, spark, path)
    return path


#: For tables whose rows hold megabytes each: Parquet looks at sizes after each row, not after a hundred, and ends row groups early.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


@contextlib.contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """Parquet is read so many rows at a time in what runs meanwhile; by default it is 4096, which the heap can't hold where each has megabytes."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, compression: str = "snappy", path: str | None = None, options: dict[str, int] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: compact, prunable by column. Dropped when the process ends."""
    path = path or fresh_path(df.sparkSession)
    df.write.options(**(options or {})).option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
