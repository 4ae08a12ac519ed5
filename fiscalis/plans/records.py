"""Queries on records that are put together from projects, findings and pages of several reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis.operators import annotation, handoff, reports, triangulate
from fiscalis.operators.mart import absorption
from fiscalis.plans.money import MONEY
from fiscalis.plans.registry import query

#: Orders are projects of their customer's nation; the parts that its lines name are findings of that nation, linked to the orders of returned lines.
MADE = """
 l AS (SELECT DISTINCT n_name AS county, o_orderkey AS project_idx, l_partkey AS finding_idx, CASE l_partkey % 3 WHEN 0 THEN 'GENERAL' WHEN 1 THEN 'INCOMPLETE_PROJECT' ELSE 'BUDGET_NOTE' END AS kind, 65 + (l_partkey % 70) / 2.0 AS score, l_returnflag = 'R' AS linked
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 f AS (SELECT DISTINCT county, finding_idx, kind, CASE WHEN finding_idx % 4 > 0 THEN 'Finding ' || finding_idx END AS finding_name FROM l),
 found AS (SELECT * FROM l WHERE linked),
 per AS (SELECT county, project_idx, list_sort(list_distinct(list(kind))) AS risks, list_sort(list(finding_idx)) AS findings, arg_min(score, finding_idx) AS match_confidence FROM found GROUP BY ALL),
 p AS (SELECT n_name AS county, o_orderkey AS project_idx, 'Project ' || o_orderkey AS project_name, o_totalprice::DECIMAL(18,2) AS contract_sum, (o_orderkey % 90)::INT AS pct FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 j AS (SELECT county, project_idx, project_name, risks, findings, match_confidence, CASE WHEN risks IS NOT NULL AND list_contains(risks, 'INCOMPLETE_PROJECT') THEN 'CORROBORATED_PROJECT_RISK' WHEN risks IS NOT NULL THEN 'OAG_NOTED' WHEN pct BETWEEN 1 AND 29 THEN 'COB_LOW_ABSORPTION' ELSE 'COB_LISTED_CLEAN' END AS verdict
   FROM p LEFT JOIN per USING (county, project_idx)
  UNION ALL SELECT county, NULL, finding_name, [kind], [finding_idx], NULL, 'OAG_ONLY_PROJECT_FLAG' FROM f WHERE finding_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM found WHERE found.county = f.county AND found.finding_idx = f.finding_idx))"""


def _reported(t):
    """(projects, findings, links)"""
    of = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("county"))
    order, part = F.col("o_orderkey"), F.col("finding_idx")
    o = t("orders").join(of, "o_custkey")
    pct = (order % 90).cast("int")
    projects = o.select("county", order.alias("project_idx"), F.concat(F.lit("Project "), order.cast("string")).alias("project_name"), F.col("o_totalprice").cast(MONEY).alias("contract_sum"),
                        F.lit(None).cast(MONEY).alias("amount_paid"), pct.alias("implementation_pct"), absorption(pct).alias("absorption"))
    kind = F.when(part % 3 == 0, "GENERAL").when(part % 3 == 1, "INCOMPLETE_PROJECT").otherwise("BUDGET_NOTE")
    lines = t("lineitem").join(o, F.col("l_orderkey") == order).select("county", order.alias("project_idx"), F.col("l_partkey").alias("finding_idx"), F.col("l_returnflag").alias("flag"))
    lines = lines.withColumn("kind", kind).withColumn("score", 65 + (part % 70) / 2)
    findings = lines.select("county", "finding_idx", "kind", F.when(part % 4 > 0, F.concat(F.lit("Finding "), part.cast("string"))).alias("finding_name")).distinct()
    return projects, findings, lines.where("flag = 'R'").drop("flag").distinct()


@query(f"WITH {MADE} SELECT county, project_idx, project_name, array_to_string(risks, ',') AS risks, array_to_string(findings, ',') AS findings, match_confidence::DOUBLE AS match_confidence, verdict FROM j")
def tri_judged(t):
    """Verdicts by given links, of all projects and of the findings that no project has."""
    d = triangulate.judged(*_reported(t))
    return d.select("county", "project_idx", "project_name", F.array_join("risks", ",").alias("risks"), F.array_join(F.col("findings").cast("array<string>"), ",").alias("findings"), "match_confidence", "verdict")


@query(rf"""WITH {MADE}, r AS (SELECT *, verdict = 'OAG_ONLY_PROJECT_FLAG' AS alone, list_filter(findings, lambda x: x % 5 > 0) AS said FROM j)
 SELECT CASE WHEN alone THEN 'nati-oagonly-' || findings[1] ELSE 'nati-' || substring(regexp_replace(lower(r.project_name), '[^a-z0-9]', '', 'g'), 1, 10) END AS project_id, r.county, r.project_name,
  CASE WHEN alone THEN CASE WHEN findings[1] % 2 = 0 THEN (findings[1] * 100)::DECIMAL(18,2) END ELSE contract_sum END AS contract_sum_kshs, pct AS implementation_pct, NOT alone AS source_cob, alone OR risks IS NOT NULL AS source_oag,
  CASE WHEN NOT alone THEN CASE WHEN pct = 0 THEN 'UNKNOWN' WHEN pct < 30 THEN 'LOW' ELSE 'NORMAL' END END AS cob_status, CASE WHEN alone OR risks IS NOT NULL THEN 'FLAGGED' ELSE 'NOT_SAMPLED' END AS oag_status,
  '[' || coalesce(array_to_string(list_transform(said, lambda x: '"On ' || x || '."'), ','), '') || ']' AS oag_findings, '[' || coalesce(array_to_string(list_transform(risks, lambda x: '"' || x || '"'), ','), '') || ']' AS oag_risk_types, verdict AS triangulation_verdict
 FROM r LEFT JOIN p ON p.county = r.county AND p.project_idx = r.project_idx""")
def record_rows(t):
    """Flat rows of the mart from judged projects: sentences of their findings (some have none), the first amount of those that no project has."""
    projects, findings, found = _reported(t)
    part = F.col("finding_idx")
    amounts = F.when(part % 2 == 0, F.array((part * 100).cast(MONEY), F.lit(1).cast(MONEY)))
    sentences = findings.select("county", "finding_idx", F.when(part % 5 > 0, F.concat(F.lit("On "), part.cast("string"), F.lit("."))).alias("sentence"), amounts.alias("amounts"))
    columns = ("project_id", "county", "project_name", "contract_sum_kshs", "implementation_pct", "source_cob", "source_oag", "cob_status", "oag_status", "oag_findings", "oag_risk_types", "triangulation_verdict")
    return reports.records(triangulate.judged(projects, findings, found), projects, sentences).select(*columns)


@query("""WITH o AS (SELECT o_custkey, string_agg(o_orderpriority || o_orderkey, chr(10) ORDER BY o_orderstatus, o_orderkey) AS oag_text FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1)
 SELECT c_mktsegment || ' - ' || c_custkey AS county, oag_text, oag_text IS NOT NULL AS oag_matched FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def report_audited(t):
    """Budget sections with the texts of the audit sections of their county, from several files, however the county is spelled."""
    segment = t("customer").select("c_custkey", "c_mktsegment")
    cob = segment.select(F.lit("b.md").alias("file"), F.col("c_custkey").alias("ord"), F.concat("c_mktsegment", F.lit(" - "), F.col("c_custkey").cast("string")).alias("county"), F.lit("").alias("text"))
    o = t("orders").where("o_orderkey % 3 > 0").join(segment, F.col("o_custkey") == F.col("c_custkey"))
    oag = o.select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("ord"), F.concat(F.initcap("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string")).alias("county"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"))
    return reports.with_audit(cob, oag).select("county", "oag_text", "oag_matched")


@query("SELECT 'doc-' || (l_orderkey // 1000) AS document_id, string_agg((l_orderkey % 1000) || '.' || l_linenumber, ',' ORDER BY l_orderkey % 1000, l_linenumber) AS tables FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def handoff_page_order(t):
    """The tables of all pages of a document, in the order of its pages: a document has 1,000 pages, an order is a page, and its lines are tables."""
    page, n = F.col("l_orderkey") % 1000, F.col("l_linenumber")
    name = F.concat(page.cast("string"), F.lit("."), n.cast("string"))
    lines = t("lineitem").select(F.concat(F.lit("doc-"), F.floor(F.col("l_orderkey") / 1000).cast("string")).alias("document_id"), page.alias("page_number"), n.alias("n"), name.alias("name")).distinct()
    pages = lines.groupBy("document_id", "page_number").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("tables"))
    return handoff.in_page_order(pages).select("document_id", F.array_join("tables", ",").alias("tables"))


@query("SELECT p_partkey, p_size, 'range' AS way FROM part WHERE p_size BETWEEN 3 AND 20 UNION ALL SELECT p_partkey, p_size, 'first' FROM part WHERE p_size BETWEEN 1 AND 12 UNION ALL SELECT p_partkey, p_size, 'both' FROM part WHERE p_size BETWEEN 5 AND 12")
def pages_limited(t):
    """Pages of a range, the first ones of a file, and both limits at once."""
    d = t("part").select("p_partkey", "p_size")
    ways = {"range": {"first": 3, "last": 20}, "first": {"most": 12}, "both": {"first": 5, "most": 12}}
    one, two, three = (annotation.pages_between(d, "p_size", **limits).withColumn("way", F.lit(way)) for way, limits in ways.items())
    return one.unionByName(two).unionByName(three)
