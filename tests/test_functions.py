import pytest
from pyspark.sql import functions as F

from fiscalis.functions import text as T
from fiscalis.operators import documents as D
from fiscalis.operators import scoring, tables, triangulate


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (T.county_key, " Trans-Nzoia  County ", "trans nzoia"), (T.county_key, "Murang'a", "murang a"), (T.title_case, "O'BRIEN taita/taveta", "O'Brien Taita/Taveta"),
        (T.money, "44,966,936,833", 44966936833), (T.money, "n/a", None), (T.leading_int, "200%", 200), (T.leading_int, "x", None), (T.plain, None, ""), (T.plain, "  A \t b ", "a b"),
        (T.base_name, "/data/?d=a%20b%5Cc.png", "c.png"), (T.report_class, "OAG-report.pdf", "Audit"), (T.report_class, "x-green-book.md", "Budget"), (T.report_class, "z", "Report"),
    ],
)
def test_text(spark, make, value, want):
    assert one(spark, value, make) == want


def test_project_rows(spark):
    row = one(spark, "Roads  Construction of X Road  Westlands  12,500, 000  4,000,000  32", D.project_row)
    assert (row.contract_sum, row.amount_paid, row.implementation_pct, row.absorption) == (12500000, 4000000, 32, "NORMAL")
    assert one(spark, "Project name 12,500,000 4,000,000", D.project_row) is None
    assert one(spark, "Only one 12,500,000", D.project_row) is None
    row = one(spark, "A ,,,,, 10,000 45%", D.project_row)
    assert row.contract_sum is None and row.implementation_pct is None and row.absorption == "UNKNOWN"
    assert one(spark, "B 10,000 20,000 0", D.project_row).absorption == "UNKNOWN"


def test_likeness():
    assert triangulate.likeness("abcd", "abcd") == 100
    assert triangulate.likeness("abcd", "bc") == pytest.approx(200 * 2 / 6)
    assert triangulate.part_likeness("bc", "abcd") == 100
    assert triangulate.sorted_likeness("road x", "x road") == 100
    assert triangulate.part_likeness("", "abc") == 0


def test_verdicts(spark):
    p = spark.createDataFrame([("a", 1, "Westlands road", 10), ("a", 2, "Market hall", 10), ("b", 3, "Clinic", 50)], "county string, project_idx long, project_name string, implementation_pct int")
    f = spark.createDataFrame(
        [("a", 1, "road westlands", "s", "FLAGGED_BY_MODEL"), ("b", 2, "Stadium roof", "s", "GENERAL_FINDING"), ("b", 3, "", "qqqq", "GENERAL_FINDING"), ("c", 4, None, None, "GENERAL_FINDING")],
        "county string, finding_idx long, finding_name string, sentence string, kind string",
    )
    got = {(r.county, r.project_name): r.verdict for r in triangulate.triangulated(p, f).collect()}
    assert got == {("a", "Westlands road"): "CORROBORATED_PROJECT_RISK", ("a", "Market hall"): "COB_LOW_ABSORPTION", ("b", "Clinic"): "COB_LISTED_CLEAN", ("b", "Stadium roof"): "OAG_ONLY_PROJECT_FLAG"}


def test_degenerate_pages(spark):
    schema = "page int, idx int, x1 int, y1 int, x2 int, y2 int, score int"
    found = spark.createDataFrame([(1, 1, 0, 0, 9, 9, 5), (1, 2, 0, 0, 9, 9, 7), (2, 1, 0, 0, 9, 9, 5)], schema)
    truth = spark.createDataFrame([(1, 1, 0, 0, 9, 9, 0), (3, 1, 0, 0, 9, 9, 0)], schema)
    got = {r.page: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in scoring.detections(found, truth, ["page"]).collect()}
    assert got == {1: (1, 1, 0, 0.5, 1.0, pytest.approx(2 / 3)), 2: (0, 1, 0, 0.0, 1.0, 0.0), 3: (0, 0, 1, 1.0, 0.0, 0.0)}


def test_structure_of_missing_cells(spark):
    """Three cells of 4 x 3 are missing: both scores are 2 * 9 / (12 + 9)."""
    cells = [(1, r * 3 + c, r, c, 1, 1, f"Cell_R{r}_C{c}") for r in range(4) for c in range(3)]
    schema = "t int, cell_idx int, row_idx int, col_idx int, row_span int, col_span int, text string"
    found = [x for x in cells if (x[2], x[3]) not in ((0, 0), (0, 1), (3, 1))]
    row = scoring.structure(spark.createDataFrame(cells, schema), spark.createDataFrame(found, schema), ["t"]).first()
    assert (row.top, row.con) == (0.8571, 0.8571)


def test_resampled_and_cosine(spark):
    d = spark.sql("SELECT array(0.0D, 1.0D) AS a, array(1.0D) AS b, cast(array() AS array<double>) AS e")
    row = d.select(tables.resampled(F.col("a"), 3), tables.resampled(F.col("b"), 3), tables.resampled(F.col("e"), 2), tables.cosine(F.col("a"), F.col("b")), tables.cosine(F.col("a"), F.col("e"))).first()
    assert list(row) == [[0, 0.5, 1], [1, 1, 1], [0, 0], 0, 0]


def test_sources(spark, tmp_path):
    from fiscalis.sources import files

    (tmp_path / "a.md").write_text("## PAGE 1\nx")
    (tmp_path / "b.txt").write_text("y")
    assert [tuple(r) for r in files.reports(spark, str(tmp_path)).collect()] == [("a.md", "## PAGE 1\nx")]
    (tmp_path / "f.json").write_text('{"metadata": {}, "financial_data": {"budget_summary": {"data": [{"county": "A County", "executive_budget_kshs": 1, "total_budget_kshs": "1,000"}]}}}')
    got = files.finance_list(spark, str(tmp_path / "f.json"), "budget_summary").first()
    assert (got.fiscal_year, got.county, got.total_budget_kshs) == ("Unknown", "A County", "1,000")
    assert files.finance_list(spark, str(tmp_path / "f.json"), "county_expenditure").count() == 0
    boxes = spark.createDataFrame([("p.png", 9, 8, "table", 1, 2, 3, 4)], "filename string, width int, height int, name string, xmin int, ymin int, xmax int, ymax int")
    files.write_annotations(boxes, str(tmp_path / "xml"))
    assert [tuple(r) for r in files.annotations(spark, str(tmp_path / "xml")).collect()] == [("p.png", 9, 8, "table", 1, 2, 3, 4)]


def test_streaming_sessions(spark, data, tmp_path):
    from fiscalis.streaming.sessions import sessions

    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{data}/events.parquet*")
    out = sessions(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    out.awaitTermination()
    batch = {tuple(r) for r in sessions(events).collect()}
    from datetime import timedelta

    got = {tuple(r) for r in spark.table("found").collect()}
    assert got <= batch
    # what the watermark has passed is given out: all sessions that ended, gap included, over an hour before the last event
    last = max(r.ts for r in events.select("ts").collect())
    of: dict = {}
    for r in events.orderBy("ts").collect():
        of.setdefault(r.user_id, []).append(r.ts)
    closed = set()
    for user, times in of.items():
        start, n = times[0], 0
        for at, after in zip(times, [*times[1:], None]):
            n += 1
            if after is None or after - at >= timedelta(minutes=30):
                if at + timedelta(minutes=30) < last - timedelta(hours=1):
                    closed.add((user, start, n))
                start, n = after, 0
    assert closed and closed <= got
