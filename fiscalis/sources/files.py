"""Readers and writers of the formats that reports and annotations come in; all go through Spark, so any store that it reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
CELL = f"struct<cell_id:string,row_idx:int,col_idx:int,row_span:int,col_span:int,cell_type:string,hierarchy_level:int,bbox:{BOX},raw_text:string,text_source:string,image_b64:string,confidence:double>"
TABLE = (
    f"struct<table_id:string,page_number:int,bbox:{BOX},confidence:double,label:string,grid:struct<rows:int,cols:int>,"
    "continuation:struct<is_continuation:boolean,continues_from:string,continues_on_next_page:boolean,linked_table_id:string,match_score:double>,"
    f"cells:array<{CELL}>,validation:struct<is_valid:boolean,checks_performed:array<string>,checks:array<string>,warnings:array<string>>>"
)
HANDOFF = f"document_id string, source_file string, page_count int, processed_at string, model_version string, tables array<{TABLE}>"
FINANCE = (
    "metadata struct<fiscal_year:string>, financial_data struct<"
    "budget_summary:struct<data:array<struct<county:string,executive_budget_kshs:bigint,assembly_budget_kshs:bigint,total_budget_kshs:string>>>,"
    "own_source_revenue:struct<data:array<struct<county:string,budgeted_kshs:bigint,actual_kshs:bigint,achievement_pct:string>>>,"
    "county_expenditure:struct<data:array<struct<county:string,executive_expenditure_kshs:bigint,assembly_expenditure_kshs:bigint,total_expenditure_kshs:string>>>>"
)


def handoffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HANDOFF).option("multiLine", True).json(path)


def cells(docs: DataFrame) -> DataFrame:
    """One row per cell of hand-off documents."""
    t = docs.select("document_id", F.explode("tables").alias("t"))
    return t.select("document_id", F.col("t.table_id").alias("table_id"), F.col("t.page_number").alias("page_number"), F.inline("t.cells"))


AUDIT = (
    "pipeline string, financial_year string, generated_at string, counties array<struct<county:string,oag_matched:boolean,"
    "dev_signal:struct<status:string,dev_pct:double,metric:string>,stats:struct<cob_projects:bigint,oag_findings:bigint,total_records:bigint>,"
    "projects:array<struct<project_id:string,county:string,financial_year:string,project_name:string,contract_sum_kshs:double,amount_paid_kshs:double,implementation_pct:double,"
    "source_cob:boolean,source_oag:boolean,dev_threshold_breach:boolean,cob_signal:struct<status:string,dev_pct:double,metric:string>,"
    "oag_forensics:struct<status:string,findings:array<string>,risk_types:array<string>,match_confidence:double>,triangulation_verdict:string>>>>"
)


def audits(spark: SparkSession, path: str) -> DataFrame:
    """Audit documents; control characters inside their strings are let through."""
    return spark.read.schema(AUDIT).option("multiLine", True).option("allowUnquotedControlChars", True).json(path)


def audit_projects(docs: DataFrame) -> DataFrame:
    """One flat row per project of audit documents, arrays as JSON; a missing part leaves its columns null, missing arrays give []."""
    d = docs.select(F.explode("counties").alias("c")).select(F.col("c.county").alias("county"), F.explode("c.projects").alias("p"))
    own = ("project_id", "financial_year", "project_name", "contract_sum_kshs", "amount_paid_kshs", "implementation_pct", "source_cob", "source_oag", "dev_threshold_breach")
    json = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    return d.select(
        "county", *(F.col(f"p.{c}").alias(c) for c in own), F.col("p.cob_signal.status").alias("cob_status"), F.col("p.cob_signal.dev_pct").alias("cob_dev_pct"),
        F.col("p.cob_signal.metric").alias("cob_metric"), F.col("p.oag_forensics.status").alias("oag_status"), F.col("p.oag_forensics.match_confidence").alias("oag_match_confidence"),
        F.col("p.triangulation_verdict").alias("triangulation_verdict"), json("p.oag_forensics.risk_types").alias("oag_risk_types"), json("p.oag_forensics.findings").alias("oag_findings"),
    )


EXPORT = (
    "id bigint, data struct<image:string>, annotations array<struct<result:array<struct<type:string,original_width:int,original_height:int,"
    "value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>>>>>"
)


def annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per label of an annotation export: task, image, type, label, percentages and size of the image. A task without results has one row of nulls."""
    d = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    d = d.select("id", F.col("data.image").alias("image"), F.explode_outer("annotations").alias("a")).select("id", "image", F.explode_outer("a.result").alias("r"))
    v = F.col("r.value")
    return d.select(
        "id", "image", F.col("r.type").alias("type"), F.explode_outer(v["rectanglelabels"]).alias("label"), *(v[c].alias(c) for c in ("x", "y", "width", "height")),
        F.col("r.original_width").alias("original_width"), F.col("r.original_height").alias("original_height"),
    )


def split_file(spark: SparkSession, path: str, key: str = "stem") -> DataFrame:
    """The trimmed lines of a split file that aren't blank, each once."""
    return spark.read.text(path).select(F.trim("value").alias(key)).where(F.col(key) != "").distinct()


def images(spark: SparkSession, path: str) -> DataFrame:
    """The PNG and JPEG images of a folder: file, report and page, from the listing alone."""
    from fiscalis.operators.annotation import page_of

    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    report, page = page_of(F.regexp_replace("file", r"\.[^.]+$", ""))
    return d.select("file", report.alias("report"), page.alias("page"))


def map_features(spark: SparkSession, path: str, name: str = "NAME_1") -> DataFrame:
    """One row per polygon feature: its name, its type, its coordinates as text and its polygons (arrays of rings of points)."""
    from fiscalis.functions.geometry import polygons

    schema = f"features array<struct<properties:struct<{name}:string>,geometry:struct<type:string,coordinates:string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, at = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    return d.select(F.col(f"f.properties.{name}").alias("county"), kind.alias("type"), at.alias("coordinates"), polygons(kind, at).alias("polygons"))


def finance_list(spark: SparkSession, path: str, section: str) -> DataFrame:
    """One of the lists of a finance bundle, with its fiscal year; a missing list is empty."""
    d = spark.read.schema(FINANCE).option("multiLine", True).json(path)
    return d.select(F.coalesce("metadata.fiscal_year", F.lit("Unknown")).alias("fiscal_year"), F.inline(f"financial_data.{section}.data"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Markdown reports, whole: file and text."""
    d = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True, pathGlobFilter="*.md")
    return d.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def annotations(spark: SparkSession, path: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """The boxes of annotation XML files; with labels only those, a file without one having a row of nulls in any case."""
    schema = "filename string, size struct<width:int,height:int,depth:int>, object array<struct<name:string,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"
    d = spark.read.schema(schema).option("rowTag", "annotation").xml(path)
    if labels is not None:
        d = d.withColumn("object", F.filter("object", lambda o: o["name"].isin(*labels)))
    return d.select("filename", "size.width", "size.height", F.inline_outer("object")).select("filename", "width", "height", "name", "bndbox.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON file for each document, nulls written out; files.handoffs() reads hand-off documents back."""
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(path)


def document_texts(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as they are: file and text, for documents whose fields vary."""
    d = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return d.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Text files, one value to a line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_split(parts: DataFrame, key: str, path: str) -> None:
    """The keys of each part (train, val, test) in a folder of its own."""
    for part in ("train", "val", "test"):
        write_lines(parts.where(F.col("part") == part).orderBy(key), key, f"{path}/{part}")


def write_tasks(pages: DataFrame, path: str, url: str = "image") -> None:
    """Labelling tasks, one JSON object each: the image's address and, beside it, all other columns."""
    rest = [c for c in pages.columns if c != url]
    pages.select(F.struct(F.col(url).alias("image"), *rest).alias("data")).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: Annotations in one XML file: a reader takes a file as a whole.
ANNOTATIONS = 10_000


def write_annotations(boxes: DataFrame, path: str, include_empty: bool = True, compression: str = "none") -> None:
    """One annotation element per file name, of the largest size that its rows state; files without a box (a row of nulls) only with include_empty. XML files grow in number with the boxes, not in size; compression as Spark's writers name it."""
    if not include_empty:
        boxes = boxes.where("name is not null")
    item = F.struct(F.col("name"), F.struct("xmin", "ymin", "xmax", "ymax").alias("bndbox"))
    boxes.groupBy("filename").agg(F.max(F.struct("width", "height")).alias("size"), F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), item))).alias("object")).write.mode("overwrite").option(
        "rowTag", "annotation"
    ).option("rootTag", "annotations").option("maxRecordsPerFile", ANNOTATIONS).option("compression", compression).xml(path)
