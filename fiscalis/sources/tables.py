"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df, as read from files. Where these are too small to be split for all cores of the application (each split has openCostInBytes at least), rows are dealt anew to all of them; larger inputs stay as they are read, without a shuffle."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    return df if int(str(size)) >= cores * least else df.repartition(2 * cores)


#: Bytes of input, as files hold the columns that are read, in one part of what is dealt by key.
PART = 1 << 19


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of a key in one task, in as many parts as its size asks for: what a task holds doesn't grow with the input. Small inputs are left to the session's number of partitions."""
    parts = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART)
    return df.repartition(parts, *keys) if parts > 2 * df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
