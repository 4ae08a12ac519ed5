"""Queries that write what they derive from the tables in one of the file formats, and answer from what the readers make of it.

A file that holds a list holds a stretch of keys of one length, so that files grow in number with the tables, not in size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.operators import annotation, loading
from fiscalis.operators.lineage import new_folder
from fiscalis.plans.forms import MADE, _boxes
from fiscalis.plans.registry import query
from fiscalis.sources import files
from fiscalis.sources.tables import dealt

#: Orders in one file.
STRETCH = 1000


def _named(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _listed(d: DataFrame, keys: list[str], item: str, order: str, name: str) -> DataFrame:
    """The items of each key as a list, by their order."""
    rows = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(item).alias("_i")))).alias(name))
    return rows.withColumn(name, F.transform(name, lambda x: x["_i"]))


@query(f"""SELECT 'doc-' || (l_orderkey // {STRETCH}) AS document_id, 't' || l_orderkey AS table_id, (l_orderkey % {STRETCH})::INT AS page_number, 'c' || l_linenumber AS cell_id, l_linenumber AS row_idx,
 CASE WHEN l_linenumber % 5 > 0 THEN min(l_partkey)::VARCHAR END AS raw_text, (l_linenumber * 10.5)::DOUBLE AS ymin, NULL::VARCHAR AS text_source FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def file_handoffs(t):
    """Hand-off documents, a table for each order and a cell for each line, through their JSON files; some texts are null, some fields left out."""
    n = F.col("l_linenumber")
    line = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("part"))
    box = F.struct(F.lit(0.0).alias("xmin"), (n * 10.5).cast("double").alias("ymin"), F.lit(90.0).alias("xmax"), (n * 10.5 + 9).cast("double").alias("ymax"))
    cell = F.struct(_named("c", "l_linenumber").alias("cell_id"), n.alias("row_idx"), F.lit(0).alias("col_idx"), box.alias("bbox"), F.when(n % 5 > 0, F.col("part")).alias("raw_text"))
    tables = _listed(line.withColumn("cell", cell), ["l_orderkey"], "cell", "l_linenumber", "cells")
    table = F.struct(_named("t", "l_orderkey").alias("table_id"), (F.col("l_orderkey") % STRETCH).cast("int").alias("page_number"), "cells")
    tables = tables.select("l_orderkey", F.floor(F.col("l_orderkey") / STRETCH).alias("at"), table.alias("table"))
    docs = _listed(tables, ["at"], "table", "l_orderkey", "tables").select(_named("doc-", "at").alias("document_id"), "tables")
    path = new_folder(docs.sparkSession, "handoffs")
    files.write_documents(docs, path)
    found = files.cells(files.handoffs(docs.sparkSession, path))
    return found.select("document_id", "table_id", "page_number", "cell_id", "row_idx", "raw_text", F.col("bbox.ymin").alias("ymin"), "text_source")


def _audits(t) -> DataFrame:
    """Audit documents of a stretch of orders each, written and read."""
    of = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("county"))
    order, urgent = F.col("o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
    checked = F.when(urgent, F.struct(
        F.lit("FLAGGED").alias("status"), F.array(F.concat(F.lit('a "quoted"\tfinding '), order.cast("string"))).alias("findings"),
        F.when(order % 2 == 0, F.array(F.lit("INCOMPLETE_PROJECT"), F.col("o_orderstatus"))).alias("risk_types"), (order % 36 + 64.5).cast("double").alias("match_confidence"),
    ))
    project = F.struct(
        _named("p", "o_orderkey").alias("project_id"), _named("Project ", "o_orderkey").alias("project_name"), F.col("o_totalprice").alias("contract_sum_kshs"), (F.col("o_orderstatus") != "P").alias("source_cob"),
        urgent.alias("source_oag"), F.struct(F.lit("LOW").alias("status"), (order % 40 / 4).cast("double").alias("dev_pct")).alias("cob_signal"), checked.alias("oag_forensics"),
    )
    d = t("orders").join(of, "o_custkey").select(F.floor(order / STRETCH).alias("at"), "county", "o_orderkey", project.alias("project"))
    d = _listed(d, ["at", "county"], "project", "o_orderkey", "projects").withColumn("c", F.struct("county", F.lit(True).alias("oag_matched"), "projects"))
    day = F.concat(F.lit("2024-05-"), F.lpad((F.col("at") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00"))
    docs = _listed(d, ["at"], "c", "county", "counties").select(_named("run-", "at").alias("pipeline"), F.lit("2023-2024").alias("financial_year"), day.alias("generated_at"), "counties")
    path = new_folder(docs.sparkSession, "audits")
    files.write_documents(docs, path)
    return files.audits(docs.sparkSession, path)


@query(r"""SELECT 'p' || o_orderkey AS project_id, n_name AS county, 'Project ' || o_orderkey AS project_name, o_totalprice AS contract_sum_kshs, o_orderstatus <> 'P' AS source_cob, NULL::BOOLEAN AS dev_threshold_breach, 'LOW' AS cob_status, (o_orderkey % 40) / 4.0 AS cob_dev_pct,
  CASE WHEN u THEN 'FLAGGED' END AS oag_status, CASE WHEN u THEN (o_orderkey % 36 + 64.5)::DOUBLE END AS oag_match_confidence, CASE WHEN u AND o_orderkey % 2 = 0 THEN '["INCOMPLETE_PROJECT","' || o_orderstatus || '"]' ELSE '[]' END AS oag_risk_types,
  CASE WHEN u THEN '["a \"quoted\"\tfinding ' || o_orderkey || '"]' ELSE '[]' END AS oag_findings
 FROM (SELECT *, o_orderpriority = '1-URGENT' AS u FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def file_audit_projects(t):
    """Audit documents through their JSON files to flat rows: missing parts are null, missing lists []."""
    columns = ("project_id", "county", "project_name", "contract_sum_kshs", "source_cob", "dev_threshold_breach", "cob_status", "cob_dev_pct", "oag_status", "oag_match_confidence", "oag_risk_types", "oag_findings")
    return files.audit_projects(_audits(t)).select(*columns)


@query(f"""SELECT row_number() OVER (ORDER BY day, pipeline) AS run_id, pipeline, strftime(day, '%Y-%m-%d %H:%M') AS generated FROM (
 SELECT DISTINCT 'run-' || (o_orderkey // {STRETCH}) AS pipeline, TIMESTAMP '2024-05-01 10:00:00' + to_days(((o_orderkey // {STRETCH}) % 28)::INT) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""")
def file_audit_runs(t):
    """The log of runs after audit documents are loaded into an empty mart."""
    docs = _audits(t)
    runs = loading.load_audit(loading.empty_mart(docs.sparkSession), docs)["audit_runs"]
    return runs.select("run_id", "pipeline", F.date_format("generated_at", "yyyy-MM-dd HH:mm").alias("generated"))


@query("""WITH n AS (SELECT n_name AS county, n_nationkey AS k, n_regionkey AS r, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation)
 SELECT county, CASE WHEN r = 4 THEN 'Unknown' ELSE 'FY ' || r END AS fiscal_year, (n * 1000)::DECIMAL(20,2) AS executive_budget, (n * 1010)::DECIMAL(20,2) AS total_budget, CASE WHEN k % 5 <> 0 THEN (n * 7)::DECIMAL(20,2) END AS revenue_target,
  CASE WHEN k % 5 <> 0 THEN n || '%' END AS achievement_pct, CASE WHEN r <> 2 THEN (n * 1005)::DECIMAL(20,2) END AS total_expenditure FROM n""")
def file_finances(t):
    """Finance bundles, one for each region, loaded into an empty mart: one lacks its year, one the list of expenditures, and some counties have no revenue row."""
    n = F.coalesce("n", F.lit(0))
    count = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    printed = lambda c: F.format_number(c, 0)
    d = t("nation").join(count, "n_nationkey", "left").select(
        "n_regionkey", "n_nationkey", F.struct(F.col("n_name").alias("county"), (n * 1000).alias("executive_budget_kshs"), (n * 10).alias("assembly_budget_kshs"), printed(n * 1010).alias("total_budget_kshs")).alias("b"),
        F.when(F.col("n_nationkey") % 5 != 0, F.struct(F.col("n_name").alias("county"), (n * 7).alias("budgeted_kshs"), n.alias("actual_kshs"), F.concat(n.cast("string"), F.lit("%")).alias("achievement_pct"))).alias("r"),
        F.struct(F.col("n_name").alias("county"), (n * 1000).alias("executive_expenditure_kshs"), (n * 5).alias("assembly_expenditure_kshs"), printed(n * 1005).alias("total_expenditure_kshs")).alias("e"),
    )
    lists = d.groupBy("n_regionkey").agg(*(F.struct(F.collect_list(c).alias("data")).alias(c) for c in ("b", "r", "e")))
    region = F.col("n_regionkey")
    docs = lists.select(
        F.struct(F.when(region != 4, _named("FY ", "n_regionkey")).alias("fiscal_year")).alias("metadata"),
        F.struct(F.col("b").alias("budget_summary"), F.col("r").alias("own_source_revenue"), F.when(region != 2, F.col("e")).alias("county_expenditure")).alias("financial_data"),
    )
    spark = docs.sparkSession
    path = new_folder(spark, "finances")
    files.write_documents(docs, path)
    found = loading.load_finance(loading.empty_mart(spark), spark, path)["county_finances"]
    return found.select("county", "fiscal_year", "executive_budget", "total_budget", "revenue_target", "achievement_pct", "total_expenditure")


@query(f"""WITH {MADE}, b AS (SELECT 'f' || l_orderkey AS filename, CASE WHEN l_linenumber % 3 = 0 THEN 'other' ELSE 'table' END AS name, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax FROM d)
 SELECT filename, 960 AS width, 740 AS height, name, xmin::INT AS xmin, ymin::INT AS ymin, xmax::INT AS xmax, ymax::INT AS ymax FROM b WHERE name = 'table' UNION ALL SELECT filename, 960, 740, NULL, NULL, NULL, NULL, NULL FROM b GROUP BY filename HAVING count(*) FILTER (name = 'table') = 0""")
def file_annotations(t):
    """Boxes through annotation XML and back, of one label; files without it have a row of nulls."""
    right, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    # boxes are dealt once, as numbers, by their file; what is equal goes, and elements are made, in the task that has the file
    made = dealt(_boxes(t).withColumn("filename", _named("f", "l_orderkey")).drop("l_orderkey"), "filename").distinct()
    d = made.select("filename", F.lit(960).alias("width"), F.lit(740).alias("height"), F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise("table").alias("name"),
                        F.col("x").alias("xmin"), F.col("y").alias("ymin"), right.alias("xmax"), low.alias("ymax"))
    path = new_folder(d.sparkSession, "annotations")
    files.write_annotations(d, path, compression="gzip")
    return files.annotations(d.sparkSession, path, ("table",))


@query(f"""WITH {MADE} SELECT o_orderkey AS id, 'http://host/img/p' || o_orderkey || '.png' AS image, CASE WHEN x IS NOT NULL THEN 'rectanglelabels' END AS type, CASE WHEN x IS NOT NULL THEN 'table' END AS label, x / 16.0 AS x, y / 16.0 AS y, w / 4.0 AS width, h / 4.0 AS height, CASE WHEN x IS NOT NULL THEN 1000 END AS original_width
 FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def file_exports(t):
    """Exports of annotations, a JSON list of tasks to a file, to one row per label; a task without labels has a row of nulls."""
    value = lambda b: F.struct((b["x"] / 16).alias("x"), (b["y"] / 16).alias("y"), (b["w"] / 4).alias("width"), (b["h"] / 4).alias("height"), F.array(F.lit("table")).alias("rectanglelabels"))
    item = lambda b: F.struct(F.lit("rectanglelabels").alias("type"), F.lit(1000).alias("original_width"), F.lit(800).alias("original_height"), value(b).alias("value"))
    # orders and boxes are dealt once, as numbers, by stretch; lists and texts are made in the task that has the stretch
    numbers = ("l_linenumber", "x", "y", "w", "h")
    boxes = _boxes(t).select(F.col("l_orderkey").alias("o_orderkey"), *numbers, F.lit(False).alias("asked"))
    orders = t("orders").select("o_orderkey", *(F.lit(None).cast(boxes.schema[c].dataType).alias(c) for c in numbers), F.lit(True).alias("asked"))
    d = dealt(orders.unionByName(boxes).withColumn("at", F.floor(F.col("o_orderkey") / STRETCH)), "at")
    d = d.groupBy("at", "o_orderkey").agg(F.count_if("asked").cast("int").alias("n"), F.collect_set(F.when(~F.col("asked") & F.col("x").isNotNull(), F.struct(*numbers))).alias("b")).where("n > 0")
    d = d.select("at", "o_orderkey", F.flatten(F.array_repeat(F.transform("b", item), F.col("n"))).alias("result"))
    image = F.concat(_named("http://host/img/p", "o_orderkey"), F.lit(".png"))
    task = F.struct(F.col("o_orderkey").alias("id"), F.struct(image.alias("image")).alias("data"), F.array(F.struct("result")).alias("annotations"))
    lists = d.groupBy("at").agg(F.to_json(F.collect_list(task)).alias("value"))
    path = new_folder(d.sparkSession, "exports")
    lists.select("value").write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return files.annotation_export(d.sparkSession, path).drop("original_height")


@query("""SELECT CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 9 THEN 'val' ELSE 'test' END AS part, 'page_' || p_partkey AS stem FROM part""")
def file_splits(t):
    """The files of a split, each read back; what occurs twice counts once."""
    k = F.col("p_partkey")
    d = t("part").select(_named("page_", "p_partkey").alias("stem"), F.when(k % 10 < 7, "train").when(k % 10 < 9, "val").otherwise("test").alias("part"))
    spark, path = d.sparkSession, new_folder(d.sparkSession, "split")
    files.write_split(d.unionByName(d), "stem", path)
    train, val, test = (files.split_file(spark, f"{path}/{part}").select(F.lit(part).alias("part"), "stem") for part in ("train", "val", "test"))
    return train.unionByName(val).unionByName(test)


@query("""SELECT replace(p_name, ' ', '-') || printf('_page_%03d', p_partkey % 2000) || '.png' AS image, replace(p_name, ' ', '-') AS source_file, (p_partkey % 2000)::INT AS page_number, p_partkey FROM part""")
def file_tasks(t):
    """Labelling tasks through their JSON lines, the report and page told by the image's name."""
    stem = F.replace("p_name", F.lit(" "), F.lit("-"))
    d = t("part").select(F.concat(annotation.page_name(stem, F.col("p_partkey") % 2000), F.lit(".png")).alias("image"), "p_partkey")
    report, page = annotation.page_of(F.regexp_replace("image", r"\.[^.]+$", ""))
    path = new_folder(d.sparkSession, "tasks")
    files.write_tasks(d.select("image", report.alias("source_file"), page.alias("page_number"), "p_partkey"), path)
    return d.sparkSession.read.schema("data struct<image:string,source_file:string,page_number:int,p_partkey:long>").json(path).select("data.*")


@query("SELECT n_name AS county, 'Polygon' AS type, '[[[' || n_nationkey || ',0],[' || (n_nationkey + 4) || ',0],[' || (n_nationkey + 4) || ',3],[' || n_nationkey || ',0]]]' AS coordinates, 1 AS n_polygons FROM nation")
def file_features(t):
    """Map features, a GeoJSON file for each region, with coordinates as text and as polygons."""
    k, point = F.col("n_nationkey"), lambda x, y: F.array(x, y)
    ring = F.array(point(k, F.lit(0)), point(k + 4, F.lit(0)), point(k + 4, F.lit(3)), point(k, F.lit(0)))
    feature = F.struct(F.struct(F.col("n_name").alias("NAME_1")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    docs = t("nation").groupBy("n_regionkey").agg(F.collect_list(feature).alias("features")).select("features")
    path = new_folder(docs.sparkSession, "features")
    files.write_documents(docs, path)
    return files.map_features(docs.sparkSession, path).select("county", "type", "coordinates", F.size("polygons").alias("n_polygons"))


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment || ', \"' || c_nationkey || '\"' END AS note FROM customer")
def file_csv(t):
    """Rows through CSV with a header, with commas, quotes and nulls."""
    d = t("customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 7 > 0, F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"'))).alias("note"))
    path = new_folder(d.sparkSession, "csv")
    files.write_csv(d, path)
    return d.sparkSession.read.schema("c_custkey long, c_name string, c_acctbal double, note string").option("header", True).csv(path)
