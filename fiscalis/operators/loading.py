"""Loading the mart: its empty tables, documents to rows, and files that are replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis.functions.text import money
from fiscalis.operators import finance, mart, store
from fiscalis.sources import files

MONEY = "decimal(20,2)"
#: The tables of the mart with their columns, and their keys.
TABLES = {
    "audit_runs": "run_id long, pipeline string, financial_year string, generated_at timestamp",
    "counties": f"county string, oag_matched boolean, dev_status string, dev_pct double, absorption_pct double, cob_projects long, oag_findings long, total_records long, total_contract {MONEY}",
    "projects": (
        f"project_id string, county string, financial_year string, project_name string, contract_sum_kshs {MONEY}, amount_paid_kshs {MONEY}, implementation_pct double, source_cob boolean, source_oag boolean, "
        "dev_threshold_breach boolean, cob_status string, cob_dev_pct double, cob_metric string, oag_status string, oag_match_confidence double, triangulation_verdict string, oag_risk_types string, oag_findings string"
    ),
    "county_finances": f"county string, fiscal_year string, executive_budget {MONEY}, assembly_budget {MONEY}, total_budget {MONEY}, revenue_target {MONEY}, revenue_actual {MONEY}, achievement_pct string, executive_expenditure {MONEY}, assembly_expenditure {MONEY}, total_expenditure {MONEY}",
}
KEYS = {"audit_runs": ["run_id"], "counties": ["county"], "projects": ["project_id"], "county_finances": ["county", "fiscal_year"]}


def empty_mart(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def _shaped(rows: DataFrame, table: str) -> DataFrame:
    """The table's columns with its types; columns that rows lack are null."""
    fields = [x.strip().split(" ", 1) for x in TABLES[table].replace(MONEY, "MONEY").split(",")]
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(MONEY if kind == "MONEY" else kind).alias(n) for n, kind in fields))


def load_audit(mart_tables: dict[str, DataFrame], docs: DataFrame) -> dict[str, DataFrame]:
    """The mart with audit documents (as files.audits() reads them) loaded: a run each behind the log, by time and pipeline, counties replaced, projects kept where their id is new (the first of a document's own)."""
    county = docs.select(F.posexplode("counties").alias("at", "c")).select(
        "at", F.col("c.county").alias("county"), F.col("c.oag_matched").alias("oag_matched"), F.col("c.dev_signal.status").alias("dev_status"), F.col("c.dev_signal.dev_pct").alias("dev_pct"),
        F.col("c.stats.cob_projects").alias("cob_projects"), F.col("c.stats.oag_findings").alias("oag_findings"), F.col("c.stats.total_records").alias("total_records"),
    )
    place = lambda d, n: d.withColumn("_seq", F.lit(n).cast("long"))
    counties = mart.upsert(place(mart_tables["counties"], -1), _shaped(county, "counties").withColumn("_seq", F.monotonically_increasing_id()), KEYS["counties"], ["_seq"]).drop("_seq")
    new = _shaped(files.audit_projects(docs), "projects").withColumn("_seq", F.monotonically_increasing_id())
    projects, _ = mart.insert_first(place(mart_tables["projects"], -1).unionByName(new), KEYS["projects"], ["_seq"])
    run = docs.select("pipeline", "financial_year", F.try_to_timestamp("generated_at").alias("generated_at"))
    return {**mart_tables, "counties": counties, "projects": projects.drop("_seq"), "audit_runs": mart.append_run(mart_tables["audit_runs"], run)}


def load_finance(mart_tables: dict[str, DataFrame], spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The mart with a finance bundle loaded: its three lists merged by county and year, known ones replaced."""
    budget = files.finance_list(spark, path, "budget_summary").select("county", "fiscal_year", F.col("executive_budget_kshs").alias("executive_budget"), F.col("assembly_budget_kshs").alias("assembly_budget"), money(F.col("total_budget_kshs")).alias("total_budget"))
    revenue = files.finance_list(spark, path, "own_source_revenue").select("county", "fiscal_year", F.col("budgeted_kshs").alias("revenue_target"), F.col("actual_kshs").alias("revenue_actual"), "achievement_pct")
    spent = files.finance_list(spark, path, "county_expenditure").select("county", "fiscal_year", F.col("executive_expenditure_kshs").alias("executive_expenditure"), F.col("assembly_expenditure_kshs").alias("assembly_expenditure"), money(F.col("total_expenditure_kshs")).alias("total_expenditure"))
    keyed = lambda d: d.withColumn("_key", F.struct("county", "fiscal_year")).drop("county", "fiscal_year").withColumn("_at", F.monotonically_increasing_id())
    merged = finance.merge(keyed(budget), keyed(revenue), keyed(spent), "_key", "_at").select("_key.*", "*").drop("_key")
    place = lambda d, n: d.withColumn("_seq", F.lit(n))
    rows = mart.upsert(place(mart_tables["county_finances"], 0), place(_shaped(merged, "county_finances"), 1), KEYS["county_finances"], ["_seq"])
    return {**mart_tables, "county_finances": rows.drop("_seq")}


def write_whole(df: DataFrame, path: str) -> None:
    """Replaces one Parquet table: written beside it, then put in its place by two renames, each of which is checked; if one fails, the old table is put back. Between the two, readers find no table: where that matters, or several tables belong together, use operators/store."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    at, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{fresh}-old")
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"{path} could not be moved; the new rows are in {fresh}")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"{fresh} could not be moved to {path}")
    if had:
        fs.delete(old, True)


def load_stored(spark: SparkSession, root: str, audits: str | None = None, finances: str | None = None) -> int:
    """Loads audit documents, a finance bundle, or both into the stored mart below root, all tables by one commit, and returns its version. A mart that isn't there yet is made."""
    if not store.version(spark, root):
        store.commit(spark, root, {name: store.Change(rows, KEYS[name]) for name, rows in empty_mart(spark).items()})

    def changes(number: int) -> dict[str, store.Change]:
        none, out = empty_mart(spark), {}
        if audits:
            found = load_audit(none, files.audits(spark, audits))
            runs = mart.new_runs(store.read(spark, root, "audit_runs", number), found["audit_runs"])
            out = {"counties": store.Change(found["counties"], KEYS["counties"], "last"), "projects": store.Change(found["projects"], KEYS["projects"], "first"), "audit_runs": store.Change(runs, KEYS["audit_runs"], "last")}
        if finances:
            out["county_finances"] = store.Change(load_finance(none, spark, finances)["county_finances"], KEYS["county_finances"], "last")
        return out

    return store.commit(spark, root, changes)
