"""Queries on finances and projects over the driver's tables: a county is a nation, a project an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.functions import text as T
from fiscalis.operators import citizen, finance, mart, reports
from fiscalis.plans.registry import query

MONEY = "decimal(18,2)"


def _finances(t) -> DataFrame:
    nation = t("nation").select("n_nationkey", F.col("n_name").alias("county"))
    budget = t("customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast(MONEY)).cast("decimal(20,2)").alias("total_budget"))
    revenue = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 3 <> 0").groupBy("c_nationkey")
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("decimal(20,2)").alias("revenue"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("n"))
        .withColumn("achievement_pct", F.concat(F.floor(F.col("done") * 250 / F.col("n")).cast("int").cast("string"), F.lit("%")))
    )
    spent = t("supplier").where("s_nationkey % 4 <> 1").groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast(MONEY)).cast("decimal(20,2)").alias("total_expenditure"))
    named = lambda d, k: d.join(nation, F.col(k) == F.col("n_nationkey")).drop(k, "n_nationkey")
    return finance.achievement(finance.merge(named(budget, "c_nationkey"), named(revenue.drop("done", "n"), "c_nationkey"), named(spent, "s_nationkey")))


FINANCES = """
 b AS (SELECT n_name AS county, sum(c_acctbal::DECIMAL(18,2))::DECIMAL(20,2) AS total_budget FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
 r AS (SELECT n_name AS county, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(20,2) AS revenue, floor(count(*) FILTER (o_orderstatus = 'F') * 250 / count(*))::INT || '%' AS achievement_pct
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 3 <> 0 GROUP BY 1),
 e AS (SELECT n_name AS county, sum(s_acctbal::DECIMAL(18,2))::DECIMAL(20,2) AS total_expenditure FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 4 <> 1 GROUP BY 1),
 f AS (SELECT county, total_budget, revenue, achievement_pct, total_expenditure, least(coalesce(try_cast(replace(achievement_pct, '%', '') AS INT), 0), 100) AS bar,
   coalesce(try_cast(replace(achievement_pct, '%', '') AS INT) >= 100, false) AS met FROM b FULL JOIN r USING (county) FULL JOIN e USING (county))"""


@query(f"WITH {FINANCES} SELECT * FROM f")
def fin_county_merge(t):
    return _finances(t)


@query(f"WITH {FINANCES} SELECT sum(coalesce(total_budget, 0))::DECIMAL(20,2) AS total_budget, sum(coalesce(total_expenditure, 0))::DECIMAL(20,2) AS total_expenditure, count(*) AS counties FROM f")
def fin_totals(t):
    return finance.totals(_finances(t))


@query(f"WITH {FINANCES} SELECT county, coalesce(total_budget, 0)::DECIMAL(20,2) AS budget, coalesce(achievement_pct, '0%') AS achieved FROM f WHERE contains(lower(county), 'on_1')")
def fin_search(t):
    found = finance.search(_finances(t), "ON_1")
    return found.select("county", F.coalesce("total_budget", F.lit(0)).cast("decimal(20,2)").alias("budget"), F.coalesce("achievement_pct", F.lit("0%")).alias("achieved"))


@query("SELECT o_orderkey, (o_totalprice::DECIMAL(18,2))::DECIMAL(20,2) AS amount FROM orders")
def fin_money_parse(t):
    comma = F.format_number(F.col("o_totalprice").cast(MONEY), 2)
    return t("orders").select("o_orderkey", T.money(comma).alias("amount"))


EV = "SELECT user_id, event_type, event_id, ts, value, event_id % 2 AS batch FROM events"


@query(f"SELECT user_id, event_type, event_id, value FROM ({EV}) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def mart_upsert_last(t):
    e = t("events").select("user_id", "event_type", "event_id", "ts", "value")
    return mart.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


PID = "lower(substring(p_brand, 1, 4)) || '-' || substring(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 1, 10)"


@query(f"SELECT {PID} AS project_id, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY {PID} ORDER BY p_partkey) = 1")
def mart_insert_first(t):
    p = t("part").withColumn("project_id", T.project_id(F.col("p_brand"), F.col("p_name")))
    return mart.insert_first(p, ["project_id"], ["p_partkey"])[0].select("project_id", "p_partkey", "p_name")


@query(f"SELECT {PID} AS project_id, count(*) - 1 AS rejected FROM part GROUP BY 1 HAVING count(*) > 1")
def mart_rejected(t):
    p = t("part").withColumn("project_id", T.project_id(F.col("p_brand"), F.col("p_name")))
    return mart.insert_first(p, ["project_id"], ["p_partkey"])[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 5 <> 0)")
def mart_fk_orphans(t):
    return mart.orphans(t("orders"), t("customer").where("c_custkey % 5 <> 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT strftime(ts, '%Y-%m-%d') AS run_day, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY 1")
def mart_run_log(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_day")).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def _projects(t) -> DataFrame:
    paid = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(20,2)").alias("amount_paid"))
    of = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("county"))
    d = t("orders").join(of, "o_custkey").join(paid, "o_orderkey", "left")
    d = d.withColumn("contract_sum", F.col("o_totalprice").cast(MONEY))
    pct = F.floor(F.col("amount_paid").cast("double") * 100 / F.col("contract_sum").cast("double")).cast("int")
    d = d.withColumn("implementation_pct", F.when((pct <= 250) & (F.col("o_orderkey") % 7 != 0), pct))
    d = d.withColumn("cob_status", mart.absorption(F.col("implementation_pct")))
    matched, severe = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"
    return d.select(
        F.col("o_orderkey").alias("project_id"), "county", F.concat(F.lit("Project "), F.col("o_orderkey").cast("string")).alias("project_name"), "contract_sum", "amount_paid", "implementation_pct", "cob_status",
        F.when(matched, "FLAGGED").otherwise("CLEAN").alias("oag_status"), F.when(matched, (F.col("o_custkey") % 36 + 65).cast("int")).alias("match_confidence"),
        (F.col("o_orderstatus") != "P").alias("source_cob"), matched.alias("source_oag"), mart.verdict(matched, severe, F.col("cob_status")).alias("verdict"),
    )


PROJECTS = """
 paid AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(20,2) AS amount_paid FROM lineitem GROUP BY 1),
 p0 AS (SELECT *, o_totalprice::DECIMAL(18,2) AS contract_sum, floor(amount_paid::DOUBLE * 100 / (o_totalprice::DECIMAL(18,2))::DOUBLE)::INT AS pct FROM orders
   JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN paid USING (o_orderkey)),
 p1 AS (SELECT *, CASE WHEN pct <= 250 AND o_orderkey % 7 <> 0 THEN pct END AS implementation_pct FROM p0),
 p2 AS (SELECT *, CASE WHEN coalesce(implementation_pct, 0) = 0 THEN 'UNKNOWN' WHEN implementation_pct < 30 THEN 'LOW' ELSE 'NORMAL' END AS cob_status, o_orderpriority = '1-URGENT' AS m FROM p1),
 p AS (SELECT o_orderkey AS project_id, n_name AS county, 'Project ' || o_orderkey AS project_name, contract_sum, amount_paid, implementation_pct, cob_status,
   CASE WHEN m THEN 'FLAGGED' ELSE 'CLEAN' END AS oag_status, CASE WHEN m THEN (o_custkey % 36 + 65)::INT END AS match_confidence, o_orderstatus <> 'P' AS source_cob, m AS source_oag,
   CASE WHEN m AND o_orderstatus = 'F' THEN 'CORROBORATED_PROJECT_RISK' WHEN m THEN 'OAG_NOTED' WHEN cob_status = 'LOW' THEN 'COB_LOW_ABSORPTION' ELSE 'COB_LISTED_CLEAN' END AS verdict FROM p2)"""


@query(f"WITH {PROJECTS} SELECT * FROM p")
def project_status(t):
    return _projects(t)


@query(f"WITH {PROJECTS} SELECT count(*) AS projects, sum(contract_sum)::DECIMAL(20,2) AS contract_total, count(*) FILTER (oag_status = 'FLAGGED' OR verdict = 'CORROBORATED_PROJECT_RISK') AS flagged, round(coalesce(avg(implementation_pct), 0), 6) AS avg_implementation FROM p")
def project_kpis(t):
    return mart.indicators(_projects(t)).withColumn("avg_implementation", F.round("avg_implementation", 6))


@query(f"WITH {PROJECTS} SELECT project_id, county, match_confidence, verdict FROM p WHERE oag_status = 'FLAGGED' OR verdict = 'CORROBORATED_PROJECT_RISK' ORDER BY coalesce(match_confidence, 0) DESC, project_id LIMIT 10")
def project_watchlist(t):
    return mart.watch_list(_projects(t)).select("project_id", "county", "match_confidence", "verdict")


@query(f"WITH {PROJECTS} SELECT project_id, county, contract_sum FROM p WHERE project_name ILIKE '%ject 1_2%' AND county = 'NATION_3' ORDER BY project_id LIMIT 100")
def project_list(t):
    return mart.list_projects(_projects(t), "NATION_3", "ject 1_2").select("project_id", "county", "contract_sum")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def project_page(t):
    return mart.page(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, 50)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey = 42")
def project_lookup(t):
    return mart.lookup(t("orders"), "o_orderkey", 42).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def project_search(t):
    return mart.find(t("part"), "RING", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query(f"WITH {PROJECTS} SELECT county, verdict, count(*) AS n FROM p GROUP BY ALL")
def verdict_by_county(t):
    return mart.verdict_totals(_projects(t), "county")


@query(f"WITH {PROJECTS} SELECT verdict, count(*) AS n FROM p GROUP BY ALL")
def verdict_totals(t):
    return mart.verdict_totals(_projects(t))


@query(f"WITH {PROJECTS} SELECT county, count(*) FILTER (source_cob) AS cob_projects, count(*) FILTER (source_oag) AS oag_findings, count(*) AS total_records FROM p GROUP BY 1")
def county_stats(t):
    return mart.county_stats(_projects(t))


@query("""WITH c AS (SELECT n_name AS county, count(c_custkey) AS records, (n_nationkey * 7) % 60 AS pct FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey)
 SELECT count(*) AS counties, coalesce(string_agg(county, ',' ORDER BY county) FILTER (pct < 30), '') AS breached, sum(records)::BIGINT AS records FROM c""")
def run_summary(t):
    n = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    c = t("nation").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("county"), F.coalesce("n", F.lit(0)).alias("total_records"), ((F.col("n_nationkey") * 7) % 60).alias("pct"))
    row = reports.run_row(reports.dev_signal(c, F.col("pct")), "2024-05-01T10:00:00", "audit")
    return row.select(F.col("total_counties").alias("counties"), F.array_join("counties_below_dev_threshold", ",").alias("breached"), F.col("total_records").cast("long").alias("records"))


@query("""WITH o AS (SELECT c_nationkey, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT n_name AS county, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ';' ORDER BY o_orderkey), '') AS projects, count(o_orderkey) AS n FROM nation LEFT JOIN o ON c_nationkey = n_nationkey GROUP BY 1""")
def county_projects_nested(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderkey", "o_orderstatus")
    d = mart.nested(t("nation"), o, "n_nationkey", ["o_orderkey", "o_orderstatus"])
    text = F.array_join(F.transform("projects", lambda p: F.concat_ws(":", p["o_orderkey"].cast("string"), p["o_orderstatus"])), ";")
    return d.select(F.col("n_name").alias("county"), text.alias("projects"), F.size("projects").cast("long").alias("n"))


@query("""SELECT o_orderkey AS project_id, coalesce('[' || string_agg('"' || l_returnflag || '"', ',' ORDER BY l_linenumber, l_partkey, l_returnflag) || ']', '[]') AS oag_risk_types FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def project_flat(t):
    flags = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("a"))
    return t("orders").join(flags, "o_orderkey", "left").select(F.col("o_orderkey").alias("project_id"), F.coalesce(F.to_json("a"), F.lit("[]")).alias("oag_risk_types"))


@query("""WITH o AS (SELECT n_name AS county, o_orderkey, o_totalprice::DECIMAL(18,2) AS price, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY n_name) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
 SELECT county, county || ' has ' || any_value(n) || ' projects, ' || least(any_value(n), 5) || ' shown. ' || string_agg('Project ' || o_orderkey || ' costs ' || price || ' shillings.', ' ' ORDER BY k) AS narration FROM o WHERE k <= 5 GROUP BY county""")
def narration(t):
    of = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("county"))
    o = t("orders").join(of, "o_custkey").withColumn("price", F.col("o_totalprice").cast(MONEY))
    line = F.concat(F.lit("Project "), F.col("o_orderkey").cast("string"), F.lit(" costs "), F.col("price").cast("string"), F.lit(" shillings."))
    return citizen.preview(o, line, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT user_id, count(*) AS n_events, s::BIGINT AS session FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY ALL")
def ext_event_sessions(t):
    from pyspark.sql import Window

    from fiscalis.streaming.sessions import sessions

    found = sessions(t("events"))
    return found.select("user_id", "n_events", F.row_number().over(Window.partitionBy("user_id").orderBy("start")).cast("long").alias("session"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'KES ' || printf('%.1f', x / 1e9) || 'B' WHEN 1 THEN 'KES ' || printf('%.1f', x / 1e6) || 'M' ELSE 'KES ' || (event_id % 900) END AS shown
 FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 90 + 1) * 1e9 WHEN 1 THEN (event_id % 900 + 1) * 1e6 ELSE (event_id % 900)::DOUBLE END AS x FROM events)""")
def fin_compact_money(t):
    e = F.col("event_id")
    x = F.when(e % 4 == 0, (e % 90 + 1) * F.lit(1e9)).when(e % 4 == 1, (e % 900 + 1) * F.lit(1e6)).otherwise((e % 900).cast("double"))
    return t("events").select("event_id", T.compact_money(x).alias("shown"))
