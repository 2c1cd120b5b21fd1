"""What the operators share: staging in the cluster's shared folder, connected components, text hashing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space characters of the contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch: what a task holds of texts at a time, on either side, is a few of them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_staged: dict[str, list[str]] = defaultdict(list)
_owner = ["session"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a local one where none is set and the
    executors are threads of the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def put(df: DataFrame, path: str) -> None:
    """df as Parquet in path, without the marker file, which nobody asks for: where Hadoop's native library is missing,
    each file and its checksum are a child process of the JVM, on the driver for the marker."""
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    put(df, path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, so that long texts don't meet in one; a smaller bound stays."""
    now = re.match(r"\d+", str(spark.conf.get(_BATCH)))
    if not now or int(now[0]) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which release() deletes like what was staged."""
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    _staged[_owner[-1]].append(path)
    return path


@contextlib.contextmanager
def owner(name: str):
    """What is staged inside belongs to name, for release()."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def release(spark: SparkSession, name: str = "session") -> None:
    """Deletes what was staged under name; results that still read it must have been written before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in _staged.pop(name, []):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    for name in list(_staged):
        with contextlib.suppress(Exception):  # the JVM may be gone
            release(spark, name)


def apart_from(grouped: DataFrame, key: str) -> DataFrame:
    """grouped by key, dealt out in another way, so that a join on the key deals it out once more: only then can the skew
    join split a key that a great part of the other side has."""
    return grouped.repartition(F.xxhash64(key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the undirected edges; root is the smallest node of its component.

    Alternating large and small stars: each step is a grouped minimum and a join on the node, so no component is ever
    gathered in one task, and the skew join splits hubs. Ends when a round changes no edge.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct()
    e, before = staged(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("v").alias("node"), F.col("m").alias("root")).union(e.select("m", "m")).distinct()
        before = now
        both = e.union(e.select("m", "v")).toDF("u", "w")
        low = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("w > u").join(apart_from(low, "u"), "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(apart_from(low, "v"), "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m")))).alias("x")).select("x.*")
        e = staged(small.where("v <> m").distinct(), "edges")


_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each lower-cased word of the whole text, in order."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def shingles(text: str, k: int = 5) -> np.ndarray:
    """A hash of each k consecutive words, in order; a text of 1 to k-1 words is one shingle, one of none has none."""
    h = word_hashes(text)
    k = min(k, len(h)) or 1
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s = mix(s * _STEP + h[j : len(h) - k + 1 + j] + np.uint64(1))
    return s


def labelled(s: np.ndarray) -> np.ndarray:
    """Each hash joined with the number of its earlier occurrences, so that all are distinct."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    at = np.arange(len(t))
    start = np.maximum.accumulate(np.where(np.r_[True, t[1:] != t[:-1]], at, 0)) if len(t) else at
    seen = np.empty(len(t), np.uint64)
    seen[order] = (at - start).astype(np.uint64)
    return mix(s + seen * _STEP)
