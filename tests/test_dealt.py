"""How work is dealt: what plans broadcast, gather and read at once must not grow with the input."""

from fiscalis import catalogue

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_broadcast_nothing(spark):
    assert "BroadcastExchange" not in plan(catalogue.queries()["score_report"](spark, SMALL))


def test_tables_of_documents_are_rows(spark):
    """No aggregate has the document alone as its key: one document's tables are never one row."""
    import re

    assert not re.search(r"Aggregate\(keys=\[document_id#\d+\]", plan(catalogue.queries()["handoff_documents"](spark, SMALL)))


def named(spark):
    p = spark.range(40).selectExpr("if(id < 0, 'Busia', 'Kisumu') county", "id project_idx", "concat('road to ', id % 4) project_name", "40 implementation_pct")
    f = spark.range(90).selectExpr("if(id < 0, 'Busia', 'Kisumu') county", "id finding_idx", "if(id % 9 = 0, 'dam', concat('road to ', id % 3)) finding_name", "if(id % 9 = 0, 'a dam', '') sentence", "'GENERAL_FINDING' kind")
    return p, f


def test_verdicts_make_no_links(spark, monkeypatch):
    from fiscalis.operators import triangulate

    p, f = named(spark)
    by_links = sorted(map(str, triangulate.judged(p, f, triangulate.links(p, f)).collect()))
    monkeypatch.setattr(triangulate, "links", None)
    assert sorted(map(str, triangulate.triangulated(p, f).collect())) == by_links


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    from fiscalis.operators import triangulate

    p, f = named(spark)
    few = triangulate.links(p, f)
    rows = sorted(map(str, few.collect()))
    monkeypatch.setattr(triangulate, "LINKS", 100)
    many = triangulate.links(p, f)
    assert sorted(map(str, many.collect())) == rows and many.rdd.getNumPartitions() > 8


def test_annotation_files_stay_small(spark, tmp_path, monkeypatch):
    from fiscalis.sources import files

    monkeypatch.setattr(files, "ANNOTATIONS", 10, raising=False)
    d = spark.range(100).selectExpr("concat('f', id) filename", "1 width", "1 height", "'table' name", "1 xmin", "1 ymin", "2 xmax", "2 ymax").coalesce(1)
    files.write_annotations(d, str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("part-*"))) >= 10 and files.annotations(spark, str(tmp_path / "a"), ("table",)).count() == 100


def test_cells_of_documents_are_neither_moved_nor_written(spark):
    """What is dealt are lines and what links need; no step is written in between, and after the tables of a page are taken apart nothing is moved."""
    p = plan(catalogue.queries()["handoff_documents"](spark, SMALL))
    assert "ExistingRDD" not in p
    exchanged = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and all("hashpartitioning(document_id#" in line and "page_number#" in line and "table_idx" not in line for line in exchanged)


def test_tables_of_pages_equal_the_steps_alone(spark):
    """Tables made in the row of their page have the cells and checks that the operators on tables of cells give, spans, odd boxes and inferred rows included."""
    from pyspark.sql import functions as F

    from fiscalis.operators import handoff, quality

    keys = handoff.DOC_KEYS
    of = ("'a' document_id", "cast(id % 3 as int) page_number", "cast(id % 2 as int) table_idx")
    tables = spark.range(6).selectExpr(*of, "'table' label", "0.9D score", "50D + 300 * (id % 2) x1", "100D y1", "330D + 300 * (id % 2) x2", "300D y2")
    rows = spark.range(24).where("id % 6 < 4").selectExpr(*of, "cast(id as int) idx", "0D x1", "id * 8D y1", "260D x2", "id * 8D + 40 + id % 5 * 9 y2", "id % 7 / 7D score")
    columns = spark.range(18).where("id % 6 > 0").selectExpr(*of, "cast(id as int) idx", "id * 15D x1", "0D y1", "id * 15D + 70 x2", "200D y2", "id % 5 / 5D score")
    spans = spark.range(12).selectExpr(*of, "cast(id as int) span_idx", "id * 9D x1", "id * 7D y1", "id * 9D + 120 x2", "id * 7D + 70 y2")
    words = spark.range(90).selectExpr("'a' document_id", "cast(id % 3 as int) page_number", "cast(id as int) word_idx", "element_at(array('x', '1,200', '600', '50%', 'A. one', ' '), cast(id % 6 + 1 as int)) text", "50 + id * 37 % 560D x1", "100 + id * 23 % 200D y1", "70 + id * 37 % 560D x2", "110 + id * 23 % 200D y2")
    native, read = words.where("word_idx % 4 = 0"), words.where("word_idx % 4 > 0")
    got = handoff.document_tables(tables, rows, columns, spans, native, read)
    r, c = (handoff.segments(d, native, tables, keys, down) for d, down in ((rows, True), (columns, False)))
    steps = handoff.build(tables, r, c, spans, native, read, keys)
    names = ("cell_id", "row_span", "col_span", "cell_type", "hierarchy_level", "text_source", "confidence")
    ours = got.select("document_id", F.inline("t.cells")).select("document_id", *names, F.col("raw_text").alias("text"), F.col("bbox.ymin").alias("y1"), F.col("bbox.xmax").alias("x2"))
    told = lambda d: sorted(map(str, d.collect()))
    assert told(ours) == told(steps.select("document_id", *names, "text", "y1", "x2")) and ours.count() > 20
    judged = quality.checked(steps.select(*keys, "row_idx", "col_idx", "row_span", "col_span", "text", "text_source", F.col("hierarchy_level").alias("level"), F.lit(True).alias("inside")), keys)
    plain = lambda d: {(x.page_number, x.table_idx): [w for w in x.warnings if "outside" not in w] for x in d.collect()}
    found = plain(got.where("size(t.cells) > 0").select(*keys, F.col("t.validation.warnings").alias("warnings")))
    assert found == plain(judged)


def test_annotations_are_dealt_once_and_written_small(spark, tmp_path, monkeypatch):
    from fiscalis.plans import exchange
    from fiscalis.sources import files

    boxes, write = [], files.write_annotations
    monkeypatch.setattr(exchange, "new_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(files, "write_annotations", lambda d, *a, **b: (boxes.append(d), write(d, *a, **b)))
    assert catalogue.queries()["file_annotations"](spark, SMALL).count() > 0
    assert plan(boxes[0].groupBy("filename").count()).count("Exchange hashpartitioning") == 1
    assert sum(f.stat().st_size for f in (tmp_path / "annotations").glob("part-*")) < 40 * boxes[0].count()


def test_feed_has_all_posts(spark):
    more = SMALL.replace("0.001", "0.01")
    posts = spark.read.parquet(f"{more}/conversations.parquet")
    feed = [(r.likes, r.conv_id, r.turn) for r in catalogue.queries()["posts_feed"](spark, more).collect()]
    assert len(feed) == posts.count() > 100 and feed == sorted(feed, reverse=True)
