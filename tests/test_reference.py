"""Operators against values worked out by hand or published for the same inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fiscalis.functions import geometry as G
from fiscalis.functions import text as T
from fiscalis.operators import annotation, citizen, detections, documents, finance, handoff, loading, mart, quality, reports, scoring, tables, triangulate
from fiscalis.sources import files

CELLS = "table_id string, cell_idx long, row_idx int, col_idx int, row_span int, col_span int, text string, x1 double, y1 double, x2 double, y2 double"


def table(rows=4, cols=3, spans=(), without=(), text="{r}{c}"):
    cells = [("t", r * cols + c, r, c, 1, 1, text.format(r=r, c=c), c * 100.0, r * 40.0, c * 100.0 + 100, r * 40.0 + 40) for r in range(rows) for c in range(cols)]
    cells = [(*x[:4], 2, *x[5:]) if x[1] in spans else x for x in cells]
    return [x for x in cells if x[1] not in without]


@pytest.mark.parametrize(
    "found, default, strict",
    [
        (table(), (1, 1, 1, 1), (1, 1, 1, 1)),
        (table(without=(0, 1, 11)), (0.9697, 0.8571, 0.75, 0.8589), (0.8571, 0.8571, 0.75, 0.8214)),
        ([(*x[:6], "no" + x[6] if x[1] % 2 == 0 else x[6], *x[7:]) for x in table()], (1, 0.5, 1, 0.8333), (1, 0.5, 1, 0.8333)),
        (table(spans=(0, 5, 10)), (0.8333, 0.8, 1, 0.8778), (0.56, 0.8, 1, 0.7867)),
    ],
)
def test_structure_scores(spark, found, default, strict):
    a, b = (spark.createDataFrame(x, CELLS) for x in (table(), found))
    for mode, want in ((False, default), (True, strict)):
        r = scoring.structure(a, b, ["table_id"], strict=mode).first()
        assert (r.top, r.con, r.loc, r.total, r.weight) == (*want, 12)
    assert scoring.weighted(scoring.structure(a, b, ["table_id"]), ["total"], "weight").first().total == strict[3]


def test_texts_that_are_empty_on_both_sides_dont_count(spark):
    a, b = (spark.createDataFrame([(*x[:6], t if x[1] == 0 else "", *x[7:]) for x in table(2, 2)], CELLS) for t in "ab")
    assert scoring.structure(a, b, ["table_id"]).first().con == 0


def test_default_scores_against_a_loop(spark, data):
    from fiscalis import catalogue
    from fiscalis.plans import pages

    read = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    sides = []
    for salt in (0, 1):
        of: dict = {}
        for r in sorted(pages._cells(read, salt).collect(), key=lambda r: r.cell_idx):
            of.setdefault(r.table_id, []).append(r)
        sides.append(of)

    def iou(a, b):
        i = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
        return i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i)

    got = {r.table_id: r for r in catalogue.queries()["score_default"](spark, data).collect()}
    for t in list(sides[0])[:200]:
        a, b = sides[0][t], sides[1][t]
        total, used = 0.0, set()
        for value, i, j in sorted(((iou(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda v: (-v[0], a[v[1]].cell_idx, b[v[2]].cell_idx)):
            if not used & {("a", i), ("b", j)}:
                used |= {("a", i), ("b", j)}
                total += value
        assert got[t].loc == pytest.approx(total / max(len(a), len(b)), abs=1e-4)


def test_same_tables(spark):
    schema = "table_id string, idx long, page_number int, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([("t1", 0, 1, 0.0, 0.0, 10.0, 10.0), ("t2", 1, 1, 20.0, 0.0, 30.0, 10.0), ("", 2, 2, 0.0, 0.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([("t1", 0, 1, 20.0, 0.0, 30.0, 9.0), ("t1", 1, 1, 0.0, 0.0, 10.0, 9.0), ("x", 2, None, 0.0, 0.0, 1.0, 1.0)], schema)
    by_id, by_box = scoring.same_tables(a, b), scoring.same_tables(a, b, 0.3)
    assert [tuple(r) for r in by_id.collect()] == [(0, 1, 1.0, "table_id")]
    assert sorted((r.a, r.b, r.score) for r in by_box.collect()) == [(0, 1, 0.9), (1, 0, 0.9)]
    assert [r.table_id for r in scoring.unmatched(a, by_id, "a").orderBy("idx").collect()] == ["t2", ""]


def test_detection_quality(spark):
    found = spark.createDataFrame([(1, 0, 0, 10, 10, 0.9)], "page int, x1 int, y1 int, x2 int, y2 int, score double")
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    rows = {r.page: r for r in quality.detection_quality(found, ["page"], 480000, pages).collect()}
    assert rows[1].quality == pytest.approx(0.8 * 100 / 480000 + 0.2 * 100 / 480000 + 0.03) and not rows[1].plausible
    assert (rows[2].n, rows[2].quality, rows[2].plausible) == (0, 0, False)


def test_page_features(spark):
    text = "The 2023 report has 12 pages and 1,234 items\n   " + "x" * 79 + "  \n\n1,000 2.5 see 45%a total Budget"
    r = documents.page_features(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), ["id"]).orderBy("id").collect()
    assert (r[0].line_count, r[0].num_hits, r[0].keyword_hits, r[0].dense_lines, r[0].long_lines) == (3, 4, 2, 1, 0)
    assert r[0].score == pytest.approx(1.2 * 4 + 0.8 * 2 + 5)
    assert (r[1].line_count, r[1].score) == (0, 0)


@pytest.mark.parametrize("b, want", [((0, 0, 700, 400), True), ((-6, 0, 700, 400), False), ((0, 0, 600, 0), False), ((0, 0, 89, 400), False), ((-4, -4, 90, 60), True), ((595, 0, 900, 800), False), ((0, 0, 60, 80), False)])
def test_plausible(spark, b, want):
    assert spark.range(1).select(G.plausible(tuple(map(F.lit, b)), F.lit(600), F.lit(800)).alias("x")).first().x is want


def test_structures_without_fields_go(spark):
    d = spark.sql("select 1 as a, named_struct('b_raw', 1, 'c_raw', 2) as s, array(named_struct('d_raw', 1)) as l, named_struct('e', 1, 'f_raw', 2) as t")
    out = citizen.without_keys(d, lambda name: name.endswith("_raw"))
    assert out.columns == ["a", "t"] and out.first().t.asDict() == {"e": 1}


@pytest.mark.parametrize("url, want", [("a+b.png", "a+b.png"), ("/x/?d=dir%2Fa%20b.png", "a b.png"), ("x?d=a?d=b/c", "c"), ("x?d=a?d=b", "a?d=b"), ("c:\\\\x\\\\y.png", "y.png"), (None, None)])
def test_base_name(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(T.base_name(F.col("u")).alias("n")).first().n == want


def test_report_info(spark):
    r = spark.createDataFrame([("some file.pdf",), ("The-Auditor-General-2023.pdf",)], "n string").select(T.report_info(F.col("n")).alias("i"), T.relevant_report(F.col("n"), "2020").alias("r")).collect()
    assert (r[0].i.institution, r[0].i.report_family, r[0].i.data_context, r[0].r) == ("Unknown", "Report", None, False)
    assert r[1].i.report_family == "Audit" and r[1].r


def test_severe_risks(spark):
    p = spark.createDataFrame([("c", 0, "Road A", 50.0)], "county string, project_idx long, project_name string, implementation_pct double")
    for kind, want in (("DUPLICATE_PAYMENT", "CORROBORATED_PROJECT_RISK"), ("GENERAL_FINDING", "OAG_NOTED")):
        f = spark.createDataFrame([("c", 0, "Road A", "s", kind)], "county string, finding_idx long, finding_name string, sentence string, kind string")
        assert triangulate.triangulated(p, f).first().verdict == want


def test_lists_with_a_county_twice(spark):
    a = spark.createDataFrame([("x", 1, 1), ("x", 2, 2)], "county string, budget int, ord int")
    b = spark.createDataFrame([("x", 5, 1), ("y", 6, 2)], "county string, revenue int, ord int")
    c = spark.createDataFrame([], "county string, spent int, ord int")
    assert sorted(tuple(r) for r in finance.merge(a, b, c, order="ord").collect()) == [("x", 2, 5, None), ("y", None, 6, None)]


def test_links_across_pages(spark):
    """Two tables of page 2 continue the first of page 1: it is linked to the last of them, with that one's score."""
    rows = [(0, 0, [0.2, 0.3, 0.5], 100, 10), (0, 1, [1.0], 50, 0), (1, 0, [0.2, 0.3, 0.5], 100, 10), (1, 1, [0.25, 0.25, 0.5], 100, 12), (2, 0, [], 100, 10)]
    t = spark.createDataFrame([("d", *r) for r in rows], "doc string, page int, idx int, profile array<double>, width int, x int")
    got = {(r.page, r.idx): (r.continues_from, r.linked, r.match_score) for r in tables.continuations(t, ["doc"]).collect()}
    cos = (0.05 + 0.075 + 0.25) / math.sqrt((0.04 + 0.09 + 0.25) * (0.0625 + 0.0625 + 0.25))
    second = round(0.7 * cos + 0.2 + 0.1 * (1 - 2 / 100), 4)
    assert got == {(0, 0): (None, 1, second), (0, 1): (None, None, None), (1, 0): (0, None, 1.0), (1, 1): (0, None, second), (2, 0): (None, None, None)}


def test_stabilised(spark):
    schema = "page int, idx long, label string, score double, x1 double, y1 double, x2 double, y2 double"
    found = spark.createDataFrame([(1, 0, "table", 0.9, 0.0, 0.0, 20.0, 20.0), (1, 1, "table", 0.8, 100.0, 100.0, 500.0, 500.0), (2, 0, "table", 0.9, 0.0, 0.0, 5.0, 5.0), (4, 0, "table", 0.7, 590.0, 0.0, 700.0, 90.0)], schema)
    cand = spark.createDataFrame([(1, 0, 300.0, 300.0, 500.0, 500.0), (1, 1, 50.0, 60.0, 250.0, 260.0), (3, 0, 10.0, 10.0, 700.0, 300.0)], "page int, idx long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.page, r.idx): (r.x1, r.y1, r.x2, r.y2, r.score, r.injected) for r in detections.stabilised(found, cand, ["page"], 600, 800).collect()}
    assert got == {
        (1, 0): (50, 60, 250, 260, 0.9, False), (1, 1): (100, 100, 500, 500, 0.8, False), (2, 0): (0, 0, 5, 5, 0.9, False), (3, 0): (10, 10, 600, 300, 0.55, True), (4, 0): (590, 0, 600, 90, 0.7, False)
    }


def test_words_without_text(spark):
    words = spark.createDataFrame([(1, 0, "a", 0, 0, 10, 10), (1, 1, " ", 0, 0, 10, 10), (1, 2, None, 0, 0, 10, 10)], "page int, word_idx int, text string, x1 int, y1 int, x2 int, y2 int")
    cells = spark.createDataFrame([(1, 5, 0, 0, 20, 20)], "page int, idx int, x1 int, y1 int, x2 int, y2 int")
    r = tables.words_in_cells(words, cells, ["page"], "idx").first()
    assert (r.n_words, r.text) == (1, "a")


COB = """foreword 3.1. something
3.1. County Government of Uasin Gishu.
3.1.1 List of Development Projects of the county with the Highest Expenditure
Sector Project Contract
Roads Kapseret road tarmac 12,500, 000 9,400,000 75
Water Borehole at Ziwa 5,000,000 1,000,000 20
Only one 5,000,000
3.1.2 Revenue
Not a project 1,000,000 2,000,000 10
3.2. Nairobi City County Government
no list"""
OAG = """preface
COUNTY EXECUTIVE OF UASIN GISHU - basis of opinion. The road was late.
County Executive o f Mombasa... nothing"""


def test_reports_from_files_to_records(spark, tmp_path):
    for name, text in (("cob.md", COB), ("oag.md", OAG)):
        (tmp_path / name).write_text(text)
    read = files.reports(spark, str(tmp_path))
    cob, oag = reports.cob_sections(read.where("file = 'cob.md'")), reports.oag_sections(read.where("file = 'oag.md'"))
    assert [r.county for r in cob.orderBy("ord").collect()] == ["Uasin Gishu", "Nairobi City"]
    assert [r.county for r in oag.orderBy("ord").collect()] == ["Uasin Gishu", "Mombasa"]
    assert {r.county: (r.oag_matched, (r.oag_text or "")[:16]) for r in reports.with_audit(cob, oag).collect()} == {"Uasin Gishu": (True, "COUNTY EXECUTIVE"), "Nairobi City": (False, "")}
    p = reports.projects(cob)
    rows = {r.project_idx: r for r in p.collect()}
    assert [(rows[k].contract_sum, rows[k].amount_paid, rows[k].implementation_pct, rows[k].absorption) for k in (0, 1)] == [(12500000.0, 9400000.0, 75.0, "NORMAL"), (5000000.0, 1000000.0, 20.0, "LOW")]
    assert len(rows) == 2 and rows[0].project_name.startswith("Roads Kapseret road tarmac")
    e = spark.createDataFrame(
        [("Uasin Gishu", 0, "The audit of Kapseret road tarmac shows stalled works.", 0, "PROJECT_NAME", " Kapseret road tarmac "), ("Uasin Gishu", 0, "The audit of Kapseret road tarmac shows stalled works.", 1, "RISK_FINDING", "stalled"),
         ("Uasin Gishu", 1, "A hospital wing of KES 7,000,000 was never begun there.", 0, "PROJECT_NAME", "hospital wing"), ("Uasin Gishu", 1, "A hospital wing of KES 7,000,000 was never begun there.", 1, "KSH_AMOUNT", "KES 7,000,000"), ("Uasin Gishu", 2, "too short", 0, "RISK_FINDING", "x")],
        "county string, finding_idx long, sentence string, ent_idx int, entity_group string, word string",
    )
    found = documents.findings(e, ["county", "finding_idx"])
    assert found.count() == 2
    t = triangulate.triangulated(p, found.withColumnRenamed("project_name", "finding_name"))
    out = {r.project_id: r for r in reports.records(t, p, found).collect()}
    assert len(next(iter(out.values()))) == 18
    assert {k: r.triangulation_verdict for k, r in out.items()} == {"uasi-roadskapse": "CORROBORATED_PROJECT_RISK", "uasi-waterboreh": "COB_LOW_ABSORPTION", "uasi-oagonly-1": "OAG_ONLY_PROJECT_FLAG"}
    only, hit = out["uasi-oagonly-1"], out["uasi-roadskapse"]
    assert (only.contract_sum_kshs, only.source_cob, only.cob_status, only.oag_risk_types) == (7000000.0, False, None, '["GENERAL_FINDING"]')
    assert json.loads(hit.oag_findings) == ["The audit of Kapseret road tarmac shows stalled works."] and hit.oag_status == "FLAGGED"


def test_audit_documents(spark, tmp_path):
    doc = {"pipeline": "p", "counties": [{"county": "A", "projects": [{"project_id": "a-1", "county": "A", "cob_signal": None, "oag_forensics": {"status": "FLAGGED", "findings": ["line\tone"], "risk_types": ["X"]}}, {"project_id": "a-2"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc).replace("\\t", "\t"))
    rows = {r.project_id: r for r in files.audit_projects(files.audits(spark, str(tmp_path / "a.json"))).collect()}
    assert (rows["a-1"].cob_status, rows["a-1"].oag_findings, rows["a-1"].oag_risk_types) == (None, '["line\\tone"]', '["X"]')
    assert (rows["a-2"].oag_status, rows["a-2"].oag_findings) == (None, "[]") and len(rows["a-1"]) == 18


def test_annotation_export(spark, tmp_path):
    rect = lambda label, x: {"type": "rectanglelabels", "original_width": 200, "original_height": 100, "value": {"x": x, "y": 10.0, "width": 50.0, "height": 95.0, "rectanglelabels": [label]}}
    tasks = [{"id": 1, "data": {"image": "/d/?d=im%2Fr_page_004.png"}, "annotations": [{"result": [rect("table", 10.9), rect("figure", 1.0), {"type": "choices"}]}]}, {"id": 2, "data": {"image": "b.png"}, "annotations": []}]
    (tmp_path / "t.json").write_text(json.dumps(tasks))
    rows = files.annotation_export(spark, str(tmp_path / "t.json"))
    b = annotation.boxes(rows)
    assert [tuple(r) for r in b.collect()] == [("r_page_004.png", "table", 200, 100, 21, 10, 121, 100)]
    assert rows.select("id").distinct().count() == 2
    with pytest.raises(ValueError):
        annotation.boxes(rows, "other")
    names = spark.createDataFrame([("a_page_b_page_012",), ("plain",)], "s string")
    assert [tuple(r) for r in names.select(*annotation.page_of(F.col("s"))).collect()] == [("a_page_b", 12), ("plain", 0)]


def test_split_sizes_and_files(spark, tmp_path):
    parts = annotation.split_parts(spark.range(107), "id")
    assert {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train": 74, "val": 16, "test": 17}
    files.write_split(parts, "id", str(tmp_path / "s"))
    assert files.split_file(spark, str(tmp_path / "s" / "val")).count() == 16
    assert annotation.pages_between(spark.range(1, 11).withColumnRenamed("id", "p"), "p", 3, 8, 5).count() == 3
    used = spark.createDataFrame([(1,)], "k int")
    pages = spark.createDataFrame([("a", 1, 2, 9.0), ("a", 2, 0, 9.0), ("a", 3, 1, 1.0), ("a", 4, 1, 9.0)], "g string, k int, n_tables int, model_score double")
    assert [r.k for r in annotation.next_tasks(pages, used, "g", "k", 1).collect()] == [2]
    assert [r.k for r in annotation.next_tasks(pages, used, "g", "k", 5, 1, 5.0, scored=True).collect()] == [4]


def test_spans_in_grids(spark):
    seg = "tid int, idx int, x1 int, y1 int, x2 int, y2 int, score double"
    rows = spark.createDataFrame([(1, i, 0, i * 10, 300, i * 10 + 10, 0.9) for i in range(3)], seg)
    cols = spark.createDataFrame([(1, i, i * 100, 0, i * 100 + 100, 30, 0.7) for i in range(3)], seg)
    spans = spark.createDataFrame([(1, 0, 100, 10, 300, 30), (1, 1, 900, 900, 950, 950)], "tid int, span_idx int, x1 int, y1 int, x2 int, y2 int")
    got = {(r.row_idx, r.col_idx): (r.row_span, r.col_span, r.cell_type, r.confidence) for r in handoff.cells(rows, cols, spans, ["tid"]).collect()}
    assert got == {(0, c): (1, 1, "column_header", 0.8) for c in range(3)} | {(1, 0): (1, 1, "data", 0.8), (2, 0): (1, 1, "data", 0.8), (1, 1): (2, 2, "header", 0.8)}


def test_mart_is_loaded(spark, tmp_path):
    project = {"project_id": "a-1", "county": "A", "project_name": "first", "contract_sum_kshs": 5.0}
    doc = {"pipeline": "p", "financial_year": "2023/2024", "generated_at": "2024-05-01T10:00:00", "counties": [{"county": "A", "oag_matched": True, "stats": {"total_records": 2}, "projects": [project, {**project, "project_name": "second"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    tables_ = loading.empty_mart(spark)
    for _ in range(2):
        tables_ = loading.load_audit(tables_, files.audits(spark, str(tmp_path / "a.json")))
    assert [r.project_name for r in tables_["projects"].collect()] == ["first"]
    assert [(r.county, r.total_records) for r in tables_["counties"].collect()] == [("A", 2)]
    assert sorted(r.run_id for r in mart.list_runs(tables_["audit_runs"]).collect()) == [1, 2]
    bundle = {"metadata": {"fiscal_year": "2023-2024"}, "financial_data": {"budget_summary": {"data": [{"county": "A County", "total_budget_kshs": "1,500"}, {"county": "A County", "total_budget_kshs": "2,500"}]}, "own_source_revenue": {"data": [{"county": "B County", "achievement_pct": "70%"}]}}}
    (tmp_path / "f.json").write_text(json.dumps(bundle))
    for _ in range(2):
        tables_ = loading.load_finance(tables_, spark, str(tmp_path / "f.json"))
    got = {r.county: (float(r.total_budget) if r.total_budget is not None else None, r.achievement_pct) for r in mart.list_finances(tables_["county_finances"]).collect()}
    assert got == {"A County": (2500.0, None), "B County": (None, "70%")}
    assert [r.county for r in mart.list_finances(tables_["county_finances"], "B County").collect()] == ["B County"]
    path = str(tmp_path / "projects")
    loading.write_whole(tables_["projects"], path)
    loading.write_whole(spark.read.parquet(path).limit(0), path)
    assert spark.read.parquet(path).count() == 0 and {p.name for p in tmp_path.iterdir()} == {"a.json", "f.json", "projects"}


def test_handoff_is_built(spark):
    seg = "tid int, idx int, x1 int, y1 int, x2 int, y2 int, score double"
    tables_ = spark.createDataFrame([(1, 2, 0, 50, 100)], "tid int, page_number int, table_idx int, x1 int, y1 int")
    rows = spark.createDataFrame([(1, i, 0, i * 20, 200, i * 20 + 20, 0.9) for i in range(2)], seg)
    cols = spark.createDataFrame([(1, i, i * 100, 0, i * 100 + 100, 40, 0.7) for i in range(2)], seg)
    spans = spark.createDataFrame([], "tid int, span_idx int, x1 int, y1 int, x2 int, y2 int")
    word = "page_number int, word_idx int, text string, x1 int, y1 int, x2 int, y2 int"
    words = spark.createDataFrame([(2, 0, "two", 90, 105, 110, 115), (2, 1, "one", 60, 105, 80, 115), (2, 2, "A. Roads", 60, 125, 90, 135)], word)
    read = spark.createDataFrame([(2, 0, "seen", 160, 105, 180, 115), (2, 1, "not taken", 60, 105, 80, 115)], word)
    got = {r.cell_id: (r.text, r.text_source, r.hierarchy_level, r.x1, r.y1) for r in handoff.build(tables_, rows, cols, spans, words, read, ["tid"]).collect()}
    assert got == {
        "page_002_table_00_r0_c0": ("one two", "pdf_text", None, 50, 100), "page_002_table_00_r0_c1": ("seen", "ocr", None, 150, 100),
        "page_002_table_00_r1_c0": ("A. Roads", "pdf_text", 1, 50, 120), "page_002_table_00_r1_c1": ("", "none", None, 150, 120),
    }
    pages = spark.createDataFrame([("d", 2, ["b"]), ("d", 1, ["a", "c"])], "document_id string, page_number int, tables array<string>")
    assert handoff.in_page_order(pages).first().tables == ["a", "c", "b"]


def test_names_of_files(spark):
    a = spark.createDataFrame([("f", "x.png"), ("f", "y.png"), ("f", "z.png")], "folder string, name string")
    b = spark.createDataFrame([("f", "1-x.png"), ("f", "x.png"), ("f", "b-y.png"), ("f", "a-y.png")], "folder string, file string")
    assert sorted((r.name, r.file) for r in annotation.same_name(a, b).collect()) == [("x.png", "x.png"), ("y.png", "a-y.png")]


def test_errors_lower_scores(spark):
    cells = spark.createDataFrame(table(), CELLS).withColumn("confidence", F.lit(1.0))
    want = {"none": 1.0, "text": 0.8333, "merged": 0.8778, "uncertain": 1.0}
    for kind, total in want.items():
        assert scoring.structure(cells, handoff.with_errors(cells, kind, ["table_id"]), ["table_id"], strict=False).first().total == total
    r = scoring.structure(cells, handoff.with_errors(cells, "missing", ["table_id"]), ["table_id"], strict=False).first()
    assert (r.con, r.loc) == (0.8571, 0.75)
    assert 0.5 < scoring.structure(cells, handoff.with_errors(cells, "moved", ["table_id"]), ["table_id"], strict=False).first().loc < 1


def test_segments_of_words(spark):
    words = spark.createDataFrame(
        [(1, 0, "a", 10, 10, 30, 20), (1, 1, "b", 200, 11, 230, 21), (1, 2, "c", 12, 60, 40, 70), (1, 3, "", 0, 90, 9, 99), (1, 4, "out", 900, 10, 950, 20)], "page_number int, word_idx int, text string, x1 int, y1 int, x2 int, y2 int"
    )
    t = spark.createDataFrame([(7, 1, 0, 0, 300, 100)], "tid int, page_number int, x1 int, y1 int, x2 int, y2 int")
    rows, cols = (handoff.segments_of_words(words, t, ["tid"], down) for down in (True, False))
    assert sorted(tuple(r) for r in rows.collect()) == [(7, 0, 0, 10, 300, 21, 0.6), (7, 1, 0, 60, 300, 70, 0.55)]
    assert sorted(tuple(r) for r in cols.collect()) == [(7, 0, 10, 0, 40, 100, 0.6), (7, 1, 200, 0, 230, 100, 0.55)]
    one = spark.createDataFrame([(7, 0, 0, 0, 300, 100, 0.9), (8, 0, 0, 0, 1, 1, 0.9)], rows.schema)
    assert sorted((r.tid, r.idx, r.score) for r in handoff.enough(one, rows, ["tid"]).collect()) == [(7, 0, 0.6), (7, 1, 0.55), (8, 0, 0.9)]
