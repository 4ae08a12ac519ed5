"""Queries over a stored mart: commits of whole tables, then changes that rewrite only the buckets they touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis.operators import mart, store
from fiscalis.operators.lineage import new_folder
from fiscalis.plans.registry import query


def _nations(t):
    """Counties with the number and sum of their customers, and other numbers for those of one region."""
    d = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(20,2)")).alias("total"))
    d = d.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("county"), "n", "total", "n_regionkey")
    return d.drop("n_regionkey"), d.where("n_regionkey = 2").select("county", (-F.col("n")).alias("n"), "total")


NATIONS = "b AS (SELECT n_name AS county, count(*) AS n, sum(c_acctbal::DECIMAL(20, 2))::DECIMAL(20, 2) AS total, any_value(n_regionkey) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"


@query(f"WITH {NATIONS} SELECT county, CASE WHEN region = 2 THEN -n ELSE n END AS n, total FROM b UNION ALL SELECT 'ELSEWHERE', 0, NULL")
def mart_stored_upsert(t):
    """Counties are stored, then those of one region and a new one replaced: only their buckets are read and written."""
    base, new = _nations(t)
    spark, root = base.sparkSession, new_folder(base.sparkSession, "mart")
    store.commit(spark, root, {"counties": store.Change(base, ["county"])})
    extra = spark.range(1).select(F.lit("ELSEWHERE").alias("county"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(base.schema["total"].dataType).alias("total"))
    store.commit(spark, root, {"counties": store.Change(new.unionByName(extra), ["county"], "last")})
    return store.read(spark, root, "counties")


@query("""WITH r AS (SELECT o_custkey % 500 AS project_id, o_orderkey, o_orderstatus, o_custkey % 3 = 0 AS later FROM orders),
 k AS (SELECT project_id, min_by(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS seq FROM r WHERE NOT later GROUP BY 1), n AS (SELECT project_id, min_by(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS seq FROM r WHERE later GROUP BY 1)
 SELECT project_id, coalesce(k.status, n.status) AS status, coalesce(k.seq, n.seq) AS seq FROM k FULL JOIN n USING (project_id)""")
def mart_stored_first(t):
    """Projects keep the row that came first, within a load and over two of them."""
    d = t("orders").select((F.col("o_custkey") % 500).alias("project_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 3 == 0).alias("later"))
    spark, root = d.sparkSession, new_folder(d.sparkSession, "mart")
    for later in ("not later", "later"):
        store.commit(spark, root, {"projects": store.Change(d.where(later).drop("later"), ["project_id"], "first", ("seq",))})
    return store.read(spark, root, "projects")


@query("""WITH r AS (SELECT (n_regionkey + 1)::BIGINT AS run_id, 'run ' || n_regionkey AS pipeline, make_timestamp(2024, 1, 1, 0, 0, 0) AS generated_at FROM nation GROUP BY ALL),
 n AS (SELECT 'audit ' || c_custkey % 7 || '-' || c_custkey AS pipeline, make_timestamp(2024, 2, (1 + c_custkey % 28)::BIGINT, 0, 0, 0) AS generated_at FROM customer)
 SELECT run_id, pipeline, generated_at::VARCHAR AS at FROM r UNION ALL SELECT (SELECT max(run_id) FROM r) + row_number() OVER (ORDER BY generated_at, pipeline), pipeline, generated_at::VARCHAR FROM n""")
def run_append_many(t):
    """Several runs at once, each with a number of its own, by time and pipeline."""
    runs = t("nation").select("n_regionkey").distinct().select((F.col("n_regionkey") + 1).cast("long").alias("run_id"), F.concat(F.lit("run "), F.col("n_regionkey").cast("string")).alias("pipeline"), F.lit("2024-01-01").cast("timestamp").alias("generated_at"))
    k = F.col("c_custkey")
    new = t("customer").select(F.concat(F.lit("audit "), (k % 7).cast("string"), F.lit("-"), k.cast("string")).alias("pipeline"), F.make_timestamp(F.lit(2024), F.lit(2), (1 + k % 28).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("generated_at"))
    return mart.append_run(runs, new).select("run_id", "pipeline", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("at"))
