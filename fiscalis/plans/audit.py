"""Queries on reports from text to records, on cell grids with spans, and on helpers of names, money and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.functions import geometry as G
from fiscalis.functions import text as T
from fiscalis.operators import annotation, citizen, detections, handoff, mart, reports
from fiscalis.operators import documents as D
from fiscalis.operators import tables as tables_
from fiscalis.plans.registry import query


def _reports(t) -> DataFrame:
    """A budget report for each customer, with its orders as a county's projects."""
    s = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("Road works "), "o_orderpriority", F.lit("  "), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(",500, 000  "), (F.col("o_custkey") % 900 + 100).cast("string"), F.lit(",250,000.5  "), (F.col("o_orderkey") % 300).cast("string")
    )
    lines = t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(lines, F.col("c_custkey") == F.col("o_custkey"), "left")
    text = F.concat(
        F.lit("# Annual review\nforeword\n3."), s("c_nationkey"), F.lit(". County Government of "), "n_name", F.lit(".\nList of development projects of the county with Highest Expenditure\nSector  Project  Contract\n"),
        F.coalesce("lines", F.lit("")), F.lit("\n3.1.2 Revenue\nRoad works 9,999,999 9,999,999\n3.48. Nairobi City County Government\nnothing listed"),
    )
    return d.select(s("c_custkey").alias("file"), text.alias("text"))


@query("""SELECT c_custkey::VARCHAR AS file, n_name AS county, 1::INT AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey::VARCHAR, 'Nairobi City', 2 FROM customer""")
def report_cob_sections(t):
    return reports.cob_sections(_reports(t)).select("file", "county", "ord")


@query(r"""WITH l AS (SELECT o_custkey, o_orderkey, (o_orderkey % 900 + 100) * 1000000 + 500000 AS c, (o_custkey % 900 + 100) * 1000000 + 250000.5 AS p, o_orderkey % 300 AS pct, 'Road works ' || o_orderpriority AS name FROM orders)
 SELECT o_custkey::VARCHAR AS file, n_name AS county, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS project_idx, name || '      ' || pct AS project_name, ((o_orderkey % 900 + 100) * 1000000 + 500000)::DOUBLE AS contract_sum, p::DOUBLE AS amount_paid,
  CASE WHEN pct <= 250 THEN pct::DOUBLE END AS implementation_pct, CASE WHEN pct > 250 OR pct = 0 THEN 'UNKNOWN' WHEN pct < 30 THEN 'LOW' ELSE 'NORMAL' END AS absorption FROM l JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey""")
def report_projects(t):
    return reports.projects(reports.cob_sections(_reports(t))).drop("ord")


@query("""SELECT c_custkey::VARCHAR AS file, 'Of ' || upper(n_name[1]) || lower(n_name[2:]) AS county, length('COUNTY EXECUTIVE OF of ' || n_name || ' – first. ')::INT AS n_chars FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT c_custkey::VARCHAR, upper(n_name[1]) || lower(n_name[2:]), length('County  Executive o f ' || n_name || '... second')::INT FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def report_oag_sections(t):
    text = F.concat(F.lit("County Executive of nothing else. COUNTY EXECUTIVE OF of "), "n_name", F.lit(" – first. County  Executive o f "), "n_name", F.lit("... second"))
    files = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("file"), text.alias("text"))
    return reports.oag_sections(files).select("file", "county", F.length("text").alias("n_chars"))


def _segments(t, spread: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, columns and spanning boxes of tables made of orders' lines."""
    n = F.col("l_linenumber")
    d = t("lineitem").select(F.col("l_orderkey").alias("tid"), n).distinct()
    rows = d.select("tid", (n - 1).alias("idx"), F.lit(0).alias("x1"), (n * 40).alias("y1"), F.lit(800).alias("x2"), (n * 40 + 30).alias("y2"), F.lit(0.9).alias("score"))
    cols = d.select("tid", (n - 1).alias("idx"), (n * 100).alias("x1"), F.lit(0).alias("y1"), (n * 100 + 80).alias("x2"), F.lit(400).alias("y2"), F.lit(0.8).alias("score"))
    s = t("orders").where("o_custkey % 3 > 0")
    k = F.col("o_custkey") % spread
    spans = s.select(F.col("o_orderkey").alias("tid"), (F.col("o_custkey") % 3).alias("span_idx"), ((k + 1) * 100).alias("x1"), (k * 40 + 40).alias("y1"), ((k + 1) * 100 + 100 * (F.col("o_custkey") % 3)).alias("x2"), (k * 40 + 70 + 40 * (F.col("o_custkey") % 2)).alias("y2"))
    return rows, cols, spans


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS tid, (l_linenumber - 1)::INT AS i FROM lineitem), s AS (SELECT o_orderkey AS tid, o_custkey % 4 AS k, o_custkey % 3 AS w, o_custkey % 2 AS h FROM orders WHERE o_custkey % 3 > 0),
 rh AS (SELECT s.tid, l.i FROM s JOIN l USING (tid) WHERE greatest(least(l.i * 40 + 70, k * 40 + 70 + 40 * h) - greatest(l.i * 40 + 40, k * 40 + 40), 0) * 100 * w >= 0.25 * least(800 * 30, 100 * w * (30 + 40 * h))),
 ch AS (SELECT s.tid, l.i FROM s JOIN l USING (tid) WHERE greatest(least(l.i * 100 + 180, k * 100 + 100 + 100 * w) - greatest(l.i * 100 + 100, k * 100 + 100), 0) * (30 + 40 * h) >= 0.25 * least(80 * 400, 100 * w * (30 + 40 * h))),
 m AS (SELECT * FROM (SELECT tid, min(i) AS r, count(*) AS rs FROM rh GROUP BY 1) JOIN (SELECT tid, min(i) AS c, count(*) AS cs FROM ch GROUP BY 1) USING (tid)),
 g AS (SELECT a.tid, a.i AS row_idx, b.i AS col_idx, r, c, rs, cs, a.tid IN (SELECT tid FROM m) AND a.i IN (SELECT i FROM rh WHERE rh.tid = a.tid) AND b.i IN (SELECT i FROM ch WHERE ch.tid = a.tid) AS hit FROM l a JOIN l b ON a.tid = b.tid LEFT JOIN m ON m.tid = a.tid)
 SELECT tid, row_idx, col_idx, CASE WHEN row_idx = r AND col_idx = c THEN rs ELSE 1 END::INT AS row_span, CASE WHEN row_idx = r AND col_idx = c THEN cs ELSE 1 END::INT AS col_span,
  CASE WHEN row_idx = 0 THEN 'column_header' WHEN row_idx = r AND col_idx = c THEN 'header' ELSE 'data' END AS cell_type FROM g WHERE NOT hit OR (row_idx = r AND col_idx = c)""")
def handoff_cells(t):
    return handoff.cells(*_segments(t, 4), ["tid"]).select("tid", "row_idx", "col_idx", "row_span", "col_span", "cell_type")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 < 2 THEN 'native ' || o_orderpriority WHEN o_custkey % 4 = 2 THEN 'read' ELSE '' END AS text, CASE WHEN o_custkey % 4 < 2 THEN 'pdf_text' WHEN o_custkey % 4 = 2 THEN 'ocr' ELSE 'none' END AS text_source,
 printf('page_%03d_table_%02d_r%d_c%d', o_orderkey, o_custkey % 120, 1, o_custkey % 7) AS cell_id FROM orders""")
def handoff_text(t):
    k = F.col("o_custkey") % 4
    native, seen = F.when(k < 2, F.concat(F.lit(" native "), "o_orderpriority")).otherwise("  "), F.when(k == 2, F.lit("read")).when(k == 1, F.lit("seen"))
    found = handoff.preferred_text(("pdf_text", native), ("ocr", seen))
    return t("orders").select("o_orderkey", found["text"].alias("text"), found["text_source"].alias("text_source"), T.cell_id(F.col("o_orderkey"), F.col("o_custkey") % 120, F.lit(1), F.col("o_custkey") % 7).alias("cell_id"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS page_number, l_linenumber AS idx FROM lineitem) SELECT page_number, printf('page_%03d_table_%02d', page_number, row_number() OVER (PARTITION BY page_number ORDER BY idx) - 1) AS table_id, false AS is_valid, 3 AS n_warnings FROM l""")
def handoff_only_detected(t):
    d = t("lineitem").select(F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("idx")).distinct().select("*", F.lit("table").alias("label"), F.lit(0.9).alias("score"), *(F.lit(1.0).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return detections.only_detected(d).select("page_number", "table_id", "is_valid", F.size("warnings").alias("n_warnings"))


@query("""WITH w AS (SELECT o_custkey, list(greatest(o_orderkey % 60, 1)::DOUBLE ORDER BY o_orderkey) AS w FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_transform(w, lambda x: printf('%.6f', round(x / list_sum(w), 6))), ' ') AS profile FROM w""")
def handoff_profile(t):
    k = F.col("o_orderkey")
    d = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(k, (k % 60).cast("double").alias("b")))).alias("s"))
    p = tables_.profile(F.transform("s", lambda x: F.lit(0.0)), F.transform("s", lambda x: x["b"]))
    return d.select("o_custkey", F.array_join(F.transform(p, lambda x: F.format_string("%.6f", x)), " ").alias("profile"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Unknown Project' ELSE p_name END AS name, replace(CASE WHEN p_size % 3 = 0 THEN 'STALLED_WORK' WHEN p_size % 3 = 1 THEN 'OAG_NOTED' ELSE 'FLAGGED' END, '_', ' ') AS risk,
 CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'COUNTY' WHEN 2 THEN 'COUNTY' WHEN 3 THEN 'AMOUNT' WHEN 4 THEN 'AMOUNT' ELSE 'MISC' END AS tag, 'embed' || 'ding ' || p_partkey AS word, p_partkey || '000' AS amount,
 'KES ' || CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE format('{:,}', p_partkey * 1000) END AS money, 'Kenyan Shillings ' || p_size AS spoken, '## PAGE ' || p_size || chr(10) || chr(10) || p_type AS heading, p_name || chr(10) || p_type AS blocks, base64(p_type::BLOB) AS encoded FROM part""")
def text_cleanup(t):
    p, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = F.when(p % 10 == 0, F.lit(None)).otherwise(F.concat("p_name", F.lit("  1,234.5 "), s, F.lit(" ")))
    label = F.concat(F.lit("LABEL_"), F.when(p % 6 == 5, "MISC").otherwise((p % 6).cast("string")))
    risks = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("STALLED_WORK"), F.lit("x")))
    return t("part").select(
        "p_partkey", T.clean_name(name).alias("name"), T.risk_label(risks, F.when(F.col("p_size") % 3 == 1, "OAG_NOTED"), F.lit(None).cast("string")).alias("risk"), T.tag_name(label).alias("tag"),
        T.joined_pieces(F.concat(F.lit(" embed ##ding "), s)).alias("word"), T.joined_pieces(F.concat(s, F.lit(" 0 ##00")), True).alias("amount"),
        T.full_money(F.when(p % 7 != 0, F.format_number(p * 1000, 0))).alias("money"), T.spoken_money(F.concat(F.lit("KES "), F.col("p_size").cast("string"))).alias("spoken"),
        T.page_heading(F.col("p_size"), F.col("p_type")).alias("heading"), T.joined_blocks(F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "), "p_type")).alias("blocks"), F.base64(F.col("p_type").cast("binary")).alias("encoded"),
    )


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n_sentences FROM documents""")
def text_sentences(t):
    return t("documents").select("doc_id", F.size(T.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("n_sentences"))


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 130) / 10.0::DOUBLE - 6 AS lat, 30 + (s_suppkey % 150) / 10.0::DOUBLE AS lon FROM supplier)
 SELECT s_suppkey, lat BETWEEN -4.9::DOUBLE AND 5.5::DOUBLE AND lon BETWEEN 33.8::DOUBLE AND 41.9::DOUBLE AS on_map, round(radians(lon), 6) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)), 6) + 0 AS y, round(s_suppkey * 300 / 72.0::DOUBLE, 6) AS px FROM s""")
def map_places(t):
    k = F.col("s_suppkey")
    lat, lon = (k % 130) / F.lit(10.0) - 6, 30 + (k % 150) / F.lit(10.0)
    x, y = G.mercator(lat, lon)
    return t("supplier").select("s_suppkey", G.on_map(lat, lon).alias("on_map"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(G.pixels(k.cast("double")), 6).alias("px"))


SAID = "'Warning. This project profile reflects a verified project risk indicator from the Office of the Auditor General. Observation note indicates: '"


@query(f"""WITH o AS (SELECT n_name AS county, o_orderkey, o_custkey, row_number() OVER (PARTITION BY n_name ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY n_name) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 l AS (SELECT *, 'Item ' || k || ': Lot ' || o_orderkey || '. ' || CASE WHEN o_custkey % 3 > 0 THEN 'The designated contract sum is Kenyan Shillings ' || o_orderkey % 1000 || '. ' ELSE '' END || CASE WHEN o_custkey % 4 > 0 THEN 'Current execution implementation is at ' || o_orderkey % 100 || ' percent. ' ELSE '' END
  || CASE WHEN o_custkey % 5 = 0 THEN {SAID} || CASE WHEN o_custkey % 2 = 0 THEN 'No file.' ELSE 'Stalled completion due to substandard materials used.' END || ' ' ELSE '' END || ' ' AS line FROM o)
 SELECT county, md5('Displaying telemetry summary for ' || county || ' County, containing ' || any_value(n) || ' project records. ' || string_agg(line, '' ORDER BY k)) AS narration FROM l GROUP BY county""")
def narration_full(t):
    of = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("county"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = t("orders").join(of, "o_custkey").select(
        "county", k.alias("idx"), F.concat(F.lit("Lot "), k.cast("string")).alias("title"), F.when(c % 3 > 0, F.concat(F.when(c % 2 == 0, "KES ").otherwise("Ksh "), (k % 1000).cast("string"))).alias("contract_sum"), F.when(c % 4 > 0, k % 100).alias("progress"),
        F.when(c % 5 == 0, "FLAGGED").alias("oag_status"), F.when(c % 2 == 0, "No file.").alias("oag_detail"),
    )
    return citizen.narrated(d).withColumn("narration", F.md5(F.col("narration").cast("binary")))


@query("""WITH f AS (SELECT n_name AS county, '2023/2024' AS fiscal_year, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT * FROM f ORDER BY county, fiscal_year LIMIT 10 OFFSET 5""")
def finance_page(t):
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("county"), F.lit("2023/2024").alias("fiscal_year")).agg(F.count("*").alias("n"))
    return mart.list_finances(d, skip=5, limit=10)


@query("""WITH r AS (SELECT (n_regionkey + 1)::BIGINT AS run_id, 'run ' || n_regionkey AS pipeline, count(*) AS total_counties FROM nation GROUP BY ALL) SELECT * FROM r UNION ALL SELECT max(run_id) + 1, 'audit', (SELECT count(*) FROM nation) FROM r""")
def run_append(t):
    runs = t("nation").groupBy("n_regionkey").agg(F.count("*").alias("total_counties")).select((F.col("n_regionkey") + 1).cast("long").alias("run_id"), F.concat(F.lit("run "), F.col("n_regionkey").cast("string")).alias("pipeline"), "total_counties")
    new = reports.run_row(reports.dev_signal(t("nation").select(F.col("n_name").alias("county"), F.lit(1).alias("total_records"))), "2024-05-01T10:00:00", "audit")
    return mart.list_runs(mart.append_run(runs, new.select("pipeline", "total_counties")))


@query("""SELECT source, bool_or(doc_id % 10 < 3 AND length(trim(text)) > 900) AS is_digital FROM documents GROUP BY 1""")
def triage_digital(t):
    text = F.when(F.length(F.trim("text")) > 900, F.col("text")).otherwise("  ")
    return D.triage(t("documents").select("source", (F.col("doc_id") % 10 + 1).alias("page"), text.alias("text")), "source")


@query("""SELECT o_custkey, md5(string_agg('## PAGE ' || o_orderkey || chr(10) || chr(10) || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey)) AS text FROM orders GROUP BY 1""")
def report_pages(t):
    d = D.report_text(t("orders").select("o_custkey", F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("text")), "o_custkey")
    return d.withColumn("text", F.md5(F.col("text").cast("binary")))


@query("""SELECT l_orderkey, greatest(min(l_partkey % 500) - 12, 0) AS x1, greatest(min(l_suppkey % 300) - 12, 0) AS y1, max(l_partkey % 500 + 20) + 12 AS x2, max(l_suppkey % 300 + 10) + 12 AS y2 FROM lineitem GROUP BY 1""")
def word_hulls(t):
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 300
    return handoff.word_hull(t("lineitem").select("l_orderkey", x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 10).alias("y2")), ["l_orderkey"])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))
 SELECT l_orderkey, count(*) FILTER (k % 5 = 0 AND k < n - 1) AS merged, count(*) FILTER (k % 2 = 0) AS marked, any_value(n) - greatest(any_value(n) // 4, 1) AS left_over FROM c GROUP BY 1""")
def score_errors(t):
    idx = F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    c = t("lineitem").select("l_orderkey", idx.alias("cell_idx"), F.lit(1).alias("row_span"), F.lit("x").alias("text")).distinct()
    n = lambda kind, what, name: handoff.with_errors(c, kind, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count_if(what).alias(name))
    d = n("merged", F.col("row_span") == 2, "merged").join(n("text", F.col("text") != "x", "marked"), "l_orderkey").join(n("missing", F.lit(True), "left_over"), "l_orderkey", "left")
    return d.withColumn("left_over", F.coalesce("left_over", F.lit(0)))


@query("""SELECT count(*) AS shared FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def split_shared(t):
    return annotation.shared(t("documents"), t("labels"), "doc_id")


@query("""SELECT event_id, epoch_us(ts) // 1000 AS post_id FROM events""")
def post_ids(t):
    return t("events").select("event_id", mart.post_id(F.col("ts")).alias("post_id"))


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN c ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0""")
def map_counties(t):
    features = t("nation").select("n_nationkey", F.concat(F.initcap("n_name"), F.lit("  County")).alias("county"))
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey % 2 = 0").groupBy(F.col("n_name").alias("county")).agg(F.count("*").alias("n"))
    return mart.on_map(features, rows).select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH w AS (SELECT l_orderkey AS tid, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS word_idx, l_suppkey % 900 AS y1, l_suppkey % 900 + 8 + l_partkey % 5 AS y2 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
 i AS (SELECT *, (y1 + y2) / 2 AS c FROM w WHERE (y1 + y2) / 2 <= 800), m AS (SELECT tid, greatest(6, 1.7::DOUBLE * list_sort(list(y2 - y1))[count(*) // 2 + 1]) AS gap FROM i GROUP BY 1),
 g AS (SELECT i.*, coalesce((c - lag(c) OVER (PARTITION BY tid ORDER BY c, word_idx) > gap)::INT, 0) AS new FROM i JOIN m USING (tid)), k AS (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY c, word_idx ROWS UNBOUNDED PRECEDING) AS idx FROM g)
 SELECT tid, idx::INT AS idx, min(y1) AS y1, max(y2) AS y2, least(1, 0.5::DOUBLE + count(*) / 20) AS score FROM k GROUP BY 1, 2""")
def handoff_segments(t):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    words = t("lineitem").select("l_orderkey", n, p, s).distinct().select(
        F.col("l_orderkey").alias("page_number"), (n.cast("long") * 1000000000 + p * 1000 + s).alias("word_idx"), F.lit("x").alias("text"), (n * 10).alias("x1"), (s % 900).alias("y1"), (n * 10 + 8).alias("x2"), (s % 900 + 8 + p % 5).alias("y2")
    )
    places = t("orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderkey").alias("page_number"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(500).alias("x2"), F.lit(800).alias("y2"))
    return handoff.segments_of_words(words, places, ["tid"], True).select("tid", "idx", "y1", "y2", "score")
