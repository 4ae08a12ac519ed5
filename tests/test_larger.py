"""What small tables don't show: keys as large tables have them, rows whose order changes from run to run, numbers just beside a half."""

import random

import pytest
from conftest import same
from pyspark.sql import functions as F

from fiscalis import catalogue
from fiscalis.functions import text as T
from fiscalis.operators import reports, tables, triangulate


def shown(spark, path, queries, **rows):
    """Writes tables of the given rows and compares the queries with their SQL."""
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(str(path / f"{name}.parquet"))
    for q in queries:
        same(spark, catalogue.queries()[q], catalogue.oracle_sql()[q], str(path))


def test_records_of_rows_in_no_fixed_order(spark):
    unstable = F.udf(random.random, "double").asNondeterministic()
    n = 300
    projects = spark.range(n).select(F.lit("Kisumu").alias("county"), F.col("id").alias("project_idx"), F.concat(F.lit("Project "), F.col("id").cast("string")).alias("project_name"), F.lit(1).cast("decimal(18,2)").alias("contract_sum"),
                                     F.lit(1).cast("decimal(18,2)").alias("amount_paid"), F.lit(40).alias("implementation_pct"), F.lit("NORMAL").alias("absorption"))
    found = spark.range(n).select(F.lit("Kisumu").alias("county"), F.col("id").alias("project_idx"), F.col("id").alias("finding_idx"), F.lit("GENERAL").alias("kind"), F.lit(80.0).alias("score"))
    findings = found.select("county", "finding_idx", "kind", F.lit("x").alias("finding_name"))
    judged = triangulate.judged(projects, findings, found).withColumn("u", unstable()).repartition(4, "u").drop("u")
    sentences = found.select("county", "finding_idx", F.concat(F.lit("On "), F.col("finding_idx").cast("string")).alias("sentence"), F.array(F.lit(1).cast("decimal(18,2)")).alias("amounts"))
    rows = reports.records(judged, projects, sentences).collect()
    assert sorted((r["project_name"], r["oag_findings"]) for r in rows) == sorted((f"Project {i}", f'["On {i}"]') for i in range(n))


def test_rows_of_items_with_long_numbers(spark, tmp_path):
    shown(spark, tmp_path, ["text_row_parser"], lineitem=("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", [(1, 1, 9999, 5), (1, 2, 10000, 5), (9000000, 3, 1199940, 59940), (7, 4, 99999, 7)]))


@pytest.mark.parametrize("x", [0.25, 0.35, 1.15, 1.25, -0.25, -1.35, 0.05, 2.675, 0.1, 99.95, 1e13 + 0.25, 1e15 + 0.5, 0.0, -0.0, -0.01, 1 / 3, 4503599627370.45])
def test_one_decimal(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(T.one_decimal(F.col("x"))).first()[0] == "%.1f" % x


def test_one_decimal_of_nothing(spark):
    assert spark.createDataFrame([(None,)], "x double").select(T.one_decimal(F.col("x"))).first()[0] is None


def test_shares_just_below_a_half(spark):
    d = spark.createDataFrame([([0.0, 0.0], [41.0, 599.0])], "a array<double>, b array<double>")
    assert d.select(tables.profile(F.col("a"), F.col("b")).alias("p")).first()["p"][0] == 0.064062


def test_scores_move_cells_once(spark, tmp_path):
    """Cells are dealt by table once: no score moves them between tasks again."""
    for name, most in (("edge_f1", 2), ("slot_fill", 2), ("score_strict", 2)):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, name


def test_parts_grow_with_the_input(spark, tmp_path, monkeypatch):
    from fiscalis.sources import tables as source

    monkeypatch.setattr(source, "PART", 1000)
    d = source.dealt(source.table(spark, "/root/testdata/sf0.001", "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    assert d.rdd.getNumPartitions() > 8 and d.groupBy("l_orderkey").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_crowded_tables_score_as_small_ones(spark, monkeypatch):
    from fiscalis.operators import scoring

    rows = [(t, i, i // 9, i % 9, 1, 1, "x", 10.0 * (i % 9), 10.0 * (i // 9), 10.0 * (i % 9) + 9 + i % 3, 10.0 * (i // 9) + 9) for t in (1, 2) for i in range(20 * t)]
    a = spark.createDataFrame(rows, "t int, cell_idx long, row_idx int, col_idx int, row_span int, col_span int, text string, x1 double, y1 double, x2 double, y2 double")
    b = a.withColumn("x1", F.col("x1") + 2).where("cell_idx % 7 > 0")
    scored = lambda: sorted(map(tuple, scoring.structure(a, b, ["t"], strict=False, digits=9).collect()))
    small = scored()
    monkeypatch.setattr(scoring, "FEW_PAIRS", 600)
    assert scored() == small
