"""Tables that statements make, written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is set and the executors are threads of the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write(df: DataFrame) -> str:
    """df written as Parquet; the whole of it or, if a row fails, nothing that is ever read."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return path


def write_lines(spark: SparkSession, lines: list[str]) -> str:
    """A text file, in a folder of the shared one."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    _written[path] = spark
    return path


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what write() made; what still reads it must have been read."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _written.pop(p, None)


@atexit.register
def _drop_all() -> None:
    for p, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone
            drop(spark, [p])


def read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
