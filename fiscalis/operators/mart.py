"""The relational mart: loading rules, status and verdicts, filters, pages, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.functions.text import county_key
from fiscalis.operators.finance import first_of, last_of
from fiscalis.operators.lineage import numbered

#: Verdicts in the order in which they are tried.
RISK, NOTED, LOW, CLEAN = "CORROBORATED_PROJECT_RISK", "OAG_NOTED", "COB_LOW_ABSORPTION", "COB_LISTED_CLEAN"
ONLY = "OAG_ONLY_PROJECT_FLAG"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All keys of both; the row that comes last in order replaces the others."""
    return last_of(old.unionByName(new), keys, order)


def insert_first(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the number of rows that lost their place per key."""
    return first_of(rows, keys, order), rows.groupBy(*keys).agg((F.count("*") - 1).alias("rejected")).where("rejected > 0")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias("_parent")), F.col(child_key) == F.col("_parent"), "left_anti")


def absorption(percent: Column) -> Column:
    """LOW under 30, NORMAL from there; nothing known of null and of 0."""
    return F.when(F.coalesce(percent, F.lit(0)) == 0, "UNKNOWN").when(percent < 30, "LOW").otherwise("NORMAL")


def verdict(matched: Column, severe: Column, status: Column) -> Column:
    return F.when(matched & severe, RISK).when(matched, NOTED).when(status.isin("LOW", "VERY_LOW"), LOW).otherwise(CLEAN)


def flagged(oag_status: Column, verdict_: Column) -> Column:
    return F.coalesce(oag_status == "FLAGGED", F.lit(False)) | F.coalesce(verdict_ == RISK, F.lit(False))


def indicators(projects: DataFrame) -> DataFrame:
    """Projects, sum of contracts, flagged ones, mean implementation of those that state one (0 if none does)."""
    return projects.agg(
        F.count("*").alias("projects"), F.sum(F.coalesce("contract_sum", F.lit(0))).cast("decimal(20,2)").alias("contract_total"),
        F.count_if(flagged(F.col("oag_status"), F.col("verdict"))).alias("flagged"), F.coalesce(F.avg("implementation_pct"), F.lit(0)).alias("avg_implementation"),
    )


def watch_list(projects: DataFrame, n: int = 10) -> DataFrame:
    """The flagged projects of the highest confidence; a missing confidence counts as 0, equals go by id."""
    rows = projects.where(flagged(F.col("oag_status"), F.col("verdict")))
    return rows.orderBy(F.desc(F.coalesce("match_confidence", F.lit(0))), "project_id").limit(n)


def page(rows: DataFrame, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page in the order of the key."""
    return rows.orderBy(key).offset(skip).limit(limit)


def find(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text, literally and in any case, in one of the columns; an empty text finds all."""
    if not text:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


def list_projects(projects: DataFrame, county: str | None = None, search: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """The filters that are given are all applied; % and _ in search are wildcards."""
    if county:
        projects = projects.where(F.col("county") == county)
    if search:
        projects = projects.where(F.col("project_name").ilike(f"%{search}%"))
    return page(projects, "project_id", skip, limit)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(key) == value).limit(1)


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str = "projects") -> DataFrame:
    """Parents with the array of their children, ordered by the fields; none gives an empty array."""
    each = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(each, key, "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))


def counties(rows: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of the counties, by name."""
    return page(rows, "county", skip, limit)


def county_with_projects(rows: DataFrame, projects: DataFrame, county: str, fields: list[str]) -> DataFrame:
    """One county with the array of its projects, or no row: both tables are filtered before anything is gathered."""
    return nested(lookup(rows, "county", county), projects.where(F.col("county") == county), "county", fields)


def insights(projects: DataFrame) -> DataFrame:
    """(insight, project_id) of projects by what is told about them: flagged by the auditor, of low absorption, without a known progress, paid over the contract."""
    each = {
        "flagged": flagged(F.col("oag_status"), F.col("verdict")), "low_absorption": absorption(F.col("implementation_pct")) == "LOW", "unknown_progress": absorption(F.col("implementation_pct")) == "UNKNOWN",
        "overpaid": F.coalesce(F.col("amount_paid") > F.col("contract_sum"), F.lit(False)),
    }
    named = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in each.items())))
    return projects.select(F.explode(named).alias("insight"), "project_id")


def verdict_totals(projects: DataFrame, *keys: str) -> DataFrame:
    return projects.groupBy(*keys, "verdict").agg(F.count("*").alias("n"))


def county_stats(projects: DataFrame) -> DataFrame:
    return projects.groupBy("county").agg(
        F.count_if("source_cob").alias("cob_projects"), F.count_if("source_oag").alias("oag_findings"), F.count("*").alias("total_records")
    )


def new_runs(runs: DataFrame, new: DataFrame, key: str = "run_id", order: tuple[str, ...] = ("generated_at", "pipeline")) -> DataFrame:
    """New runs, numbered on from the last of the log in the order of the given columns (those that new has; all of its columns where it has none of them)."""
    last = runs.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
    new = new.drop(key)
    return numbered(new, [c for c in order if c in new.columns] or new.columns, "_place").withColumn(key, F.lit(last) + F.col("_place")).select(runs.columns)


def append_run(runs: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """The log with new runs behind it."""
    return runs.unionByName(new_runs(runs, new, key))


def list_runs(runs: DataFrame, skip: int = 0, limit: int = 100, key: str = "run_id") -> DataFrame:
    return page(runs, key, skip, limit)


def list_finances(finances: DataFrame, county: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """Finances of one county, or of all, by county and year."""
    if county:
        finances = finances.where(F.col("county") == county)
    keys = [k for k in ("county", "fiscal_year") if k in finances.columns]
    return finances.orderBy(*keys).offset(skip).limit(limit)


def capped(rows: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """What a client sees that asks for so many rows at most."""
    return page(rows, key, 0, most)


def feed(posts: DataFrame, likes: str, *order: str, n: int | None = None) -> DataFrame:
    """The posts by likes, of equals the newest first; with n only so many."""
    d = posts.orderBy(F.desc(likes), *map(F.desc, order))
    return d if n is None else d.limit(n)


def post_id(ts: Column) -> Column:
    """Milliseconds from 1970 to a time without a zone."""
    return F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def on_map(features: DataFrame, rows: DataFrame, key: str = "county") -> DataFrame:
    """Map features with the rows of their county, whichever of its names both use."""
    right = rows.withColumn("_key", county_key(F.col(key))).drop(key)
    return features.withColumn("_key", county_key(F.col(key))).join(right, "_key", "left").drop("_key")
