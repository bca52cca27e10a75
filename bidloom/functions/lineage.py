"""Cutting a plan where several later ones build on it, and folders for tables of a session."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names for all executors; a local master without one gets a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="bidloom-settled-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is there goes when the process ends."""
    path = f"{shared_folder(spark)}/bidloom-{uuid.uuid4().hex}"

    def dropped() -> None:
        jvm = spark.sparkContext._jvm
        if jvm is not None and spark.sparkContext._jsc is not None:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(dropped)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and of a known size, so that joins with small ones are broadcast."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
