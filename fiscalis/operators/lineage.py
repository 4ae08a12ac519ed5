"""Cutting the lineage of loops, folders that all see, and places of rows in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a new one in local mode where it is unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor repeats nothing that came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a joined to b, which is large whatever its estimate says: rows that an explode makes aren't in it. Neither side is broadcast."""
    return a.join(b.hint("merge"), on, how)


#: Rows in one part of what is dealt by key.
ROWS = 200_000


def parts_of(*dfs: DataFrame) -> int:
    """Parts that the rows of dfs ask for, ROWS to each, and as many as there are cores at least."""
    return max(dfs[0].sparkSession.sparkContext.defaultParallelism, -(-sum(d.count() for d in dfs) // ROWS))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row, from 1 on, in the given order (nulls first; rows that are equal in it in any order).

    Rows are dealt by ranges of the order; each task numbers its own, and only the counts of the tasks, one row each, are summed up.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    told = df.withColumn("_row", F.monotonically_increasing_id())
    run = cut(told.repartitionByRange(*by, F.col("_row")).sortWithinPartitions(*by, F.col("_row")).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    n = run.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    n = n.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return run.join(F.broadcast(n), part == F.col("_part")).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
