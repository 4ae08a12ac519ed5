"""Oversight reports from text to audit rows: county sections, project lists, findings, verdicts, records of the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.functions.text import county_words, project_id, title_case
from fiscalis.operators import mart
from fiscalis.operators.documents import project_row
from fiscalis.operators.lineage import cut

#: Headings of county sections in the two kinds of reports, and what encloses a list of projects.
COB_HEADING = r"3\.\d+\.\s+(?:County Government of\s+([^.\n\r\t]+)|(Nairobi City) County Government)"
OAG_HEADING = r"(?i:(?:County\s+Executive\s+o\s*f)\s+([^.\n\r\t\-–]+)(?:\s*[-–]|\s*\.\.\.))"
PROJECT_LIST = r"(?s)[Ll]ist of [Dd]evelopment [Pp]rojects.{0,100}Highest Expenditure(.*?)(?:3\.\d+\.\d+\s+[A-Z]|\z)"
YEAR = "2023/2024"
METRIC = "Dev spend > 30%"


def _sections(files: DataFrame, heading: str) -> DataFrame:
    """(file, ord, text, first heading's groups) from one heading to the next; what stands before the first goes."""
    pieces = F.posexplode(F.split(F.coalesce("text", F.lit("")), f"(?={heading})"))
    return files.select("file", pieces.alias("ord", "text")).where(F.col("text").rlike(f"^{heading}"))


def cob_sections(files: DataFrame) -> DataFrame:
    """(file, ord, county, text) of budget reports. files: file, text; several files are taken one behind the other by name."""
    d = _sections(files, COB_HEADING)
    name = F.concat(F.regexp_extract("text", f"^{COB_HEADING}", 1), F.regexp_extract("text", f"^{COB_HEADING}", 2))
    return d.select("file", "ord", F.trim(name).alias("county"), "text")


def oag_sections(files: DataFrame) -> DataFrame:
    """(file, ord, county, text) of audit reports; names in title case."""
    d = _sections(files, OAG_HEADING)
    return d.select("file", "ord", title_case(F.trim(F.regexp_extract("text", f"^{OAG_HEADING}", 1))).alias("county"), "text")


def projects(sections: DataFrame) -> DataFrame:
    """The projects of a section's list of highest expenditure, a line each: file, ord, county, project_idx and the fields of the line."""
    lines = F.posexplode(F.split(F.regexp_extract("text", PROJECT_LIST, 1), "\n"))
    d = sections.select("file", "ord", "county", lines.alias("line_no", "line")).where(F.trim("line") != "")
    d = d.select("file", "ord", "county", "line_no", project_row(F.col("line")).alias("p")).where("p is not null")
    at = F.row_number().over(Window.partitionBy("file", "ord").orderBy("line_no")) - 1
    return d.select("file", "ord", "county", at.cast("long").alias("project_idx"), F.col("p.name").alias("project_name"), "p.contract_sum", "p.amount_paid", "p.implementation_pct", "p.absorption")


def with_audit(cob: DataFrame, oag: DataFrame) -> DataFrame:
    """Each budget section with the text of the audit sections of its county, in their order, and whether there are any."""
    part = F.struct("file", "ord", "text")
    texts = oag.groupBy(county_words(F.col("county")).alias("_key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "\n").alias("oag_text"))
    return cob.withColumn("_key", county_words(F.col("county"))).join(texts, "_key", "left").withColumn("oag_matched", F.col("oag_text").isNotNull()).drop("_key")


def dev_signal(sections: DataFrame, percent=None) -> DataFrame:
    """Adds dev_status, dev_pct and dev_breach; without an expression for the percentage each county counts as OK at 35."""
    pct = F.lit(35.0) if percent is None else percent
    return sections.withColumn("dev_pct", pct).withColumn("dev_status", F.when(F.col("dev_pct") < 30, "FLAGGED").otherwise("OK")).withColumn("dev_breach", F.col("dev_status") == "FLAGGED")


def records(triangulated: DataFrame, found: DataFrame, sentences: DataFrame) -> DataFrame:
    """Flat rows of the mart, 18 columns, from triangulate.triangulated(): found are the projects (county, project_idx and fields), sentences the findings (county, finding_idx, sentence, amounts). A key that many projects share keeps one row when loaded."""
    listed = cut(triangulated.withColumn("_of", F.monotonically_increasing_id()))  # read twice, and a number made anew could go to another row
    one = listed.select("_of", "county", F.posexplode_outer("findings").alias("at", "finding_idx")).join(sentences, ["county", "finding_idx"], "left")
    told = one.groupBy("_of").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("at", "sentence")))), lambda x: x["sentence"]).alias("sentences"),
        F.min_by(F.get("amounts", F.lit(0)), F.when(F.col("amounts").isNotNull(), F.col("at"))).alias("first_amount"), F.min("finding_idx").alias("first_finding"),
    )
    d = listed.join(told, "_of").join(found.drop("project_name"), ["county", "project_idx"], "left")
    only = F.col("verdict") == mart.ONLY
    key = F.when(only, F.concat(F.lower(F.substring("county", 1, 4)), F.lit("-oagonly-"), F.col("first_finding").cast("string"))).otherwise(project_id(F.col("county"), F.col("project_name")))
    matched = only | F.col("risks").isNotNull()
    json = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    return d.select(
        key.alias("project_id"), "county", F.lit(YEAR).alias("financial_year"), "project_name", F.when(only, F.col("first_amount")).otherwise(F.col("contract_sum")).alias("contract_sum_kshs"),
        F.col("amount_paid").alias("amount_paid_kshs"), "implementation_pct", (~only).alias("source_cob"), matched.alias("source_oag"), F.lit(False).alias("dev_threshold_breach"),
        F.when(~only, F.col("absorption")).alias("cob_status"), F.when(~only, F.lit(35.0)).alias("cob_dev_pct"), F.when(~only, F.lit(METRIC)).alias("cob_metric"),
        F.when(matched, "FLAGGED").otherwise("NOT_SAMPLED").alias("oag_status"), json("sentences").alias("oag_findings"), json("risks").alias("oag_risk_types"), F.col("match_confidence").alias("oag_match_confidence"),
        F.col("verdict").alias("triangulation_verdict"),
    )


def run_row(counties: DataFrame, run_ts: str, pipeline: str, year: str = YEAR) -> DataFrame:
    """One row for the log of runs. counties: county, dev_breach, total_records."""
    breached = F.sort_array(F.collect_list(F.when(F.col("dev_breach"), F.col("county"))))
    return counties.agg(
        F.lit(pipeline).alias("pipeline"), F.lit(year).alias("financial_year"), F.try_to_timestamp(F.lit(run_ts)).alias("generated_at"), F.count("*").alias("total_counties"),
        breached.alias("counties_below_dev_threshold"), F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"),
    )
