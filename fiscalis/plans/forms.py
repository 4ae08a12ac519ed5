"""Queries on the forms in which boxes, names, pages and feeds are given out."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis.functions import geometry as G
from fiscalis.functions import text as T
from fiscalis.operators import annotation, mart
from fiscalis.plans import money
from fiscalis.plans.registry import query

MADE = """d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey % 900 AS x, l_suppkey % 700 AS y, 20 + l_partkey % 80 AS w, 30 + l_suppkey % 60 AS h FROM lineitem)"""


def _boxes(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", (p % 900).alias("x"), (s % 700).alias("y"), (20 + p % 80).alias("w"), (30 + s % 60).alias("h"))


def _made(t):
    return _boxes(t).distinct()


@query(f"""WITH {MADE} SELECT *, greatest(x - 12, 0) AS x1, greatest(y - 12, 0) AS y1, least(x + w + 12, 960) AS x2, least(y + h + 12, 740) AS y2, round((x + w / 2) / 960, 9) AS cx, round((y + h / 2) / 740, 9) AS cy, round(w / 960, 9) AS part_x, round(h / 740, 9) AS part_y FROM d""")
def box_forms(t):
    """Boxes with a margin inside the page, and as centres and sizes in parts of it."""
    d = _made(t)
    b = (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    wide, high = F.lit(960), F.lit(740)
    return d.select(
        "*", *(c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), G.padded(b, 12, wide, high))), *(F.round(c, 9).alias(n) for n, c in zip(("cx", "cy", "part_x", "part_y"), G.centred(b, wide, high)))
    )


@query(f"""WITH {MADE} SELECT 'f' || l_orderkey AS filename, '740 960' AS orig_size, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN 'other' ELSE 'table' END || ' ' || (2 * x + w), ';' ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 'other' ELSE 'table' END, (x + w / 2.0) / 960, (y + h / 2.0) / 740, w, h) AS boxes FROM d GROUP BY 1""")
def training_boxes(t):
    d = _made(t).select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("filename"), F.lit(960).alias("width"), F.lit(740).alias("height"), F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise("table").alias("name"), F.col("x").alias("xmin"), F.col("y").alias("ymin"),
        (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("h")).alias("ymax"),
    )
    each = F.zip_with("labels", "boxes", lambda n, b: F.concat(n, F.lit(" "), F.round(b[0] * 1920).cast("long").cast("string")))
    return annotation.training_boxes(d).select("filename", F.array_join(F.col("orig_size").cast("array<string>"), " ").alias("orig_size"), F.array_join(each, ";").alias("boxes"))


@query(r"""SELECT p_partkey, replace(p_name, ' ', '-') || printf('_page_%03d', p_partkey % 2000) AS page, replace(p_name, ' ', '-') AS report, (p_partkey % 2000)::INT AS number, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS title,
 CASE p_partkey % 4 WHEN 0 THEN '0.0%' WHEN 1 THEN '25.0%' WHEN 2 THEN '50.0%' ELSE '75.0%' END AS share FROM part""")
def page_names(t):
    stem = F.replace("p_name", F.lit(" "), F.lit("-"))
    page = annotation.page_name(stem, F.col("p_partkey") % 2000)
    report, number = annotation.page_of(page)
    return t("part").select("p_partkey", page.alias("page"), report.alias("report"), number.alias("number"), T.report_title(stem).alias("title"), T.percent_text(F.col("p_partkey") % 4 / 4).alias("share"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1000")
def mart_capped(t):
    return mart.capped(t("customer").select("c_custkey", "c_name"), "c_custkey")


@query("""WITH o AS (SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) SELECT n_name AS county, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS projects FROM nation LEFT JOIN o ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY 1""")
def county_one(t):
    """One county with its projects; both sides are filtered before they are gathered."""
    of = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("county"))
    d = mart.county_with_projects(t("nation").select(F.col("n_name").alias("county")), t("orders").join(of, "o_custkey"), "NATION_7", ["o_orderkey"])
    return d.select("county", F.array_join(F.transform("projects", lambda p: p["o_orderkey"].cast("string")), ",").alias("projects"))


@query("SELECT n_name AS county, n_regionkey FROM nation ORDER BY n_name LIMIT 10 OFFSET 5")
def county_page(t):
    return mart.counties(t("nation").select(F.col("n_name").alias("county"), "n_regionkey"), 5, 10)


@query(f"""WITH {money.PROJECTS}, i AS (SELECT project_id, unnest(list_filter([CASE WHEN coalesce(oag_status = 'FLAGGED', false) OR coalesce(verdict = 'CORROBORATED_PROJECT_RISK', false) THEN 'flagged' END, CASE WHEN cob_status = 'LOW' THEN 'low_absorption' END, CASE WHEN cob_status = 'UNKNOWN' THEN 'unknown_progress' END, CASE WHEN amount_paid > contract_sum THEN 'overpaid' END], lambda x: x IS NOT NULL)) AS insight FROM p)
 SELECT insight, count(*) AS n, sum(project_id)::BIGINT AS ids FROM i GROUP BY 1""")
def project_insights(t):
    return mart.insights(money._projects(t)).groupBy("insight").agg(F.count("*").alias("n"), F.sum("project_id").alias("ids"))
