"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session; where it is unset, a new one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    now = spark.sparkContext.getCheckpointDir()
    if not now:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        now = spark.sparkContext.getCheckpointDir()
    return now.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would take for it, so that every executor means the same place."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def release(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, once its last reader is done."""
    remove(df.sparkSession, df._shared_path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and with it the place to ask
        pass


def materialize(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. A lost executor then costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # nothing needs the write's shuffle files once it is done
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def parts(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about that many bytes of text, at least one row each."""
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for low, high in zip(cut[:-1], cut[1:]):
        if high > low:
            yield b.slice(low, high - low)


def text_of(col: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under names of our own, so that other columns of df, whatever their names, can't clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def before_each(items: Column, size: Callable[[Column], Column], block: int = 256) -> Column:
    """For an array, an array of the sums of all sizes (ints) before each item.

    A fold that lengthens an array copies it at each step; here a block at a time is folded, then the blocks' sums.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    add = lambda s, n: F.struct((s["at"] + n).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    places = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / block).cast("int"), F.lit(0)))
    blocks = F.transform(places, lambda i: F.aggregate(F.slice(items, i * block + 1, F.lit(block)), start, lambda s, x: add(s, size(x))))
    bases = F.aggregate(blocks, start, lambda s, b: add(s, b["at"]), lambda s: s["out"])
    return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["out"], lambda x: x + base)))


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint, given only where the counted rows stay within the bound; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df
