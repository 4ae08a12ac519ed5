"""A stored mart: several Parquet tables that change together, in buckets of which only the touched ones are rewritten.

Each table lies in buckets by a hash of its keys. A commit writes the rows of touched buckets under fresh names; then one
small version file, put in its place by a single rename, names the folder of every bucket of every table. Readers take the
last version, so they see all tables before a commit or all after it. A writer that is lost before the rename leaves files
that no version names (sweep() removes them), never a gap. If two writers start from one version, the second's rename finds
the number taken, and it starts anew from what the first has left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fiscalis.operators.finance import first_of, last_of

BUCKETS = 64
#: Tries of a commit against other writers.
TRIES = 20


@dataclass
class Change:
    """Rows for a table. how: "last", rows replace those of their keys; "first", only rows of new keys are added; "whole", the table is replaced. Of rows with one key among themselves the last, or first, counts, in the order of some of their columns (none: any one)."""

    rows: DataFrame
    keys: list[str]
    how: str = "whole"
    order: tuple[str, ...] = ()
    buckets: int = BUCKETS


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, root)
    at = path(f"{root}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, root: str) -> int:
    """The number of the last version; 0 if there is none."""
    return max(_versions(spark, root), default=0)


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """What a version names: for each table its schema, keys, number of buckets, and the folder of each bucket that has rows."""
    number = version(spark, root) if number is None else number
    if not number:
        return {}
    fs, path = _fs(spark, root)
    jvm = spark.sparkContext._jvm
    stream = fs.open(path(f"{root}/versions/{number:012d}.json"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, table: dict, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    paths = [p for b, p in table["paths"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table as a version has it, the last one if none is given."""
    return _read(spark, manifest(spark, root, number)[name])


def of_keys(spark: SparkSession, root: str, name: str, keys: DataFrame) -> DataFrame:
    """The rows of some keys, from their buckets alone."""
    table = manifest(spark, root)[name]
    return _read(spark, table, _touched(keys, table)).join(keys.select(*table["keys"]).distinct(), table["keys"], "left_semi")


def _touched(rows: DataFrame, table: dict) -> list[int]:
    """The buckets of some rows; at most as many as there are buckets."""
    return sorted(r[0] for r in rows.select(bucket(table["keys"], table["buckets"])).distinct().collect())


def merged(old: DataFrame, change: Change) -> DataFrame:
    """The rows of the touched buckets after a change."""
    both = old.withColumn("_age", F.lit(0)).unionByName(change.rows.select(old.columns).withColumn("_age", F.lit(1)))
    pick = first_of if change.how == "first" else last_of
    return pick(both, change.keys, ["_age", *change.order]).drop("_age")


def written(spark: SparkSession, root: str, name: str, change: Change, table: dict | None) -> dict:
    """Writes what a change makes of a table, touched buckets only, under a fresh name, and returns the table's new entry."""
    if table is None or change.how == "whole":
        table = {"schema": json.loads(change.rows.schema.json()), "keys": change.keys, "buckets": change.buckets, "paths": {}}
    d = merged(_read(spark, table, _touched(change.rows, table) if table["paths"] else []), change)
    at = f"{root}/data/{name}/{uuid.uuid4().hex}"
    d.withColumn("_bucket", bucket(table["keys"], table["buckets"])).repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(at)
    fs, path = _fs(spark, root)
    found = {f.getPath().getName().split("=")[1]: f"{at}/{f.getPath().getName()}" for f in fs.listStatus(path(at)) if f.getPath().getName().startswith("_bucket=")}
    return {**table, "paths": {**table["paths"], **found}}


def publish(spark: SparkSession, root: str, number: int, tables: dict) -> bool:
    """Makes a version visible by one rename; False if another writer has taken its number."""
    fs, path = _fs(spark, root)
    fresh = path(f"{root}/versions/_{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    at = path(f"{root}/versions/{number:012d}.json")
    if not fs.exists(at) and fs.rename(fresh, at):
        return True
    fs.delete(fresh, False)
    return False


def commit(spark: SparkSession, root: str, changes: dict[str, Change] | Callable[[int], dict[str, Change]]) -> int:
    """Applies all changes, or none of them, and returns the version that has them. Changes that depend on what is stored are given as a function of the version that they start from."""
    for _ in range(TRIES):
        number = version(spark, root)
        tables = manifest(spark, root, number)
        now = changes(number) if callable(changes) else changes
        new = {**tables, **{name: written(spark, root, name, change, tables.get(name)) for name, change in now.items()}}
        if publish(spark, root, number + 1, new):
            return number + 1
    raise RuntimeError(f"other writers were faster {TRIES} times")


def sweep(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes all but the last versions, and folders that none of the kept ones names; no writer may be at work. Returns the number of folders removed."""
    fs, path = _fs(spark, root)
    numbers = _versions(spark, root)
    named = {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for n in numbers[-keep:] for t in manifest(spark, root, n).values() for p in t["paths"].values()}
    for n in numbers[:-keep]:
        fs.delete(path(f"{root}/versions/{n:012d}.json"), False)
    gone = 0
    for table in fs.listStatus(path(f"{root}/data")) if fs.exists(path(f"{root}/data")) else []:
        for folder in fs.listStatus(table.getPath()):
            if folder.getPath().getName() not in named:
                gone += bool(fs.delete(folder.getPath(), True))
    return gone
