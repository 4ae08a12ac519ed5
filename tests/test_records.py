"""Hand-off documents, reports on them, shapes, names and bundles, on small cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from fiscalis.functions import geometry as G
from fiscalis.operators import annotation, citizen, detections, handoff, maps, quality
from fiscalis.sources import files

KEYS = "document_id string, page_number int, table_idx int"
BOX = "x1 double, y1 double, x2 double, y2 double"


def test_documents_dont_mix_and_are_read_back(spark, tmp_path):
    """Two documents with equal pages and tables, one without any; one table has no model's rows, one no rows at all."""
    docs = spark.createDataFrame([(d, f"{d}.pdf", 2, "now", "m") for d in ("a", "b", "none")], "document_id string, source_file string, page_count int, processed_at string, model_version string")
    tables = spark.createDataFrame([(d, p, 0, "table", 0.9, 50.0, 100.0, 250.0, 140.0) for d in "ab" for p in (1, 2)], f"{KEYS}, label string, score double, {BOX}")
    rows = [(d, 1, 0, i, 0.0, i * 20.0, 200.0, i * 20.0 + 20, 0.9) for d in "ab" for i in range(2)] + [("b", 1, 0, 2, 0.0, 21.0, 200.0, 39.0, 0.3)]  # the last overlaps another
    cols = [(d, 1, 0, i, i * 100.0, 0.0, i * 100.0 + 100, 40.0, 0.7) for d in "ab" for i in range(2)]
    seg = f"{KEYS}, idx int, {BOX}, score double"
    words = [("a", 1, 0, "fromA", 60.0, 105.0, 80.0, 115.0), ("b", 1, 0, "fromB", 60.0, 105.0, 80.0, 115.0), ("a", 2, 0, "up", 60.0, 102.0, 80.0, 108.0), ("a", 2, 1, "down", 60.0, 130.0, 80.0, 136.0)]
    word = f"document_id string, page_number int, word_idx int, text string, {BOX}"
    spans = spark.createDataFrame([("a", 1, 0, 0, 0.0, 20.0, 200.0, 40.0)], f"{KEYS}, span_idx int, {BOX}")
    read = spark.createDataFrame([("b", 1, 0, "seen", 160.0, 105.0, 180.0, 115.0)], word)
    got = handoff.documents(docs, tables, spark.createDataFrame(rows, seg), spark.createDataFrame(cols, seg), spans, spark.createDataFrame(words, word), read)
    files.write_documents(got, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.json"))) == 3
    back = {r.document_id: r for r in files.handoffs(spark, str(tmp_path / "out")).collect()}
    plain = lambda d: {r.document_id: r.t for r in d.select("document_id", F.to_json(F.struct("source_file", "page_count", "processed_at", "model_version", "tables")).alias("t")).collect()}
    assert plain(got) == plain(files.handoffs(spark, str(tmp_path / "out")))
    texts = {(d, t.page_number): [(c.cell_id[16:], c.raw_text, c.row_span, c.col_span) for c in t.cells] for d, r in back.items() for t in r.tables}
    assert texts == {
        ("a", 1): [("0_r0_c0", "fromA", 1, 1), ("0_r0_c1", "", 1, 1), ("0_r1_c0", "", 1, 2)], ("b", 1): [("0_r0_c0", "fromB", 1, 1), ("0_r0_c1", "seen", 1, 1), ("0_r1_c0", "", 1, 1), ("0_r1_c1", "", 1, 1)],
        ("a", 2): [("0_r0_c0", "up", 1, 1), ("0_r1_c0", "down", 1, 1)], ("b", 2): [("0_r0_c0", "", 1, 1)],
    }
    b2 = back["b"].tables[1]
    assert b2.grid.asDict() == {"rows": 1, "cols": 1} and (b2.cells[0].bbox.xmin, b2.cells[0].bbox.ymax, b2.cells[0].confidence) == (50.0, 140.0, 0.0)
    assert back["a"].tables[0].continuation.linked_table_id == "page_002_table_00" or not back["a"].tables[1].continuation.is_continuation
    assert back["none"].tables == [] and back["b"].tables[0].validation.checks_performed[:3] == ["grid_reconstruction", "pdf_text_fill", "ocr_fallback"]


def test_detected_tables_are_numbered_by_document(spark):
    found = spark.createDataFrame([(d, 1, k, "table", 0.9, 0.0, 0.0, 1.0, 1.0) for d in "ab" for k in (5, 7)], f"document_id string, page_number int, idx int, label string, score double, {BOX}")
    rows = detections.only_detected(found).collect()
    assert sorted((r.document_id, r.table_id) for r in rows) == [(d, f"page_001_table_0{k}") for d in "ab" for k in (0, 1)]
    assert rows[0].warnings == list(detections.ONLY_DETECTED)


def test_reports_on_documents_of_any_form(spark, tmp_path):
    cell = lambda text, **more: {"raw_text": text, **more}
    table = lambda **more: {"table_id": "t", "page_number": 1, "bbox": {}, "grid": None, "continuation": {"is_continuation": True}, "cells": [cell("x"), cell("", text_source="ocr", col_span=2), cell("y", confidence=0.1)], "validation": {}, **more}
    root = {"document_id": None, "source_file": "", "page_count": 0, "processed_at": 1, "model_version": []}
    bare = table()
    del bare["table_id"], bare["grid"], bare["cells"]
    given = {
        "full": json.dumps({**root, "tables": [table(), table()]}), "bare": json.dumps({**root, "tables": [table(), bare]}), "none": json.dumps({**root, "tables": []}), "null": json.dumps({**root, "tables": None}), "odd": json.dumps({"tables": [3, {"cells": 4}], "page_count": 1}),
        "text": "no json", "list": "[1]", "empty": "", "nothing": None,
    }
    got = {r.k: r for r in quality.document_report(spark.createDataFrame(list(given.items()), "k string, text string"), "k").collect()}
    full = got["full"]
    assert tuple(full.totals) == (2, 6, 2, 2, 2, 2, 2) and (full.errors, full.warnings, full.ready_for_nlp) == ([], ["high_low_confidence_cell_ratio"], True) and tuple(full.checks) == (True, True, True, False)
    assert got["bare"].errors == [f"unknown:missing_table_field:{f}" for f in ("table_id", "grid", "cells")]
    assert got["none"].errors == got["null"].errors == ["no_cells_found"] and tuple(got["none"].checks) == (True, False, True, True)
    every = [f"unknown:missing_table_field:{f}" for f in quality.TABLE_FIELDS]
    assert got["odd"].errors == [f"missing_root_field:{f}" for f in quality.ROOT_FIELDS if f not in ("tables", "page_count")] + every + [e for e in every if not e.endswith(":cells")] + ["no_cells_found"]
    for k in ("text", "list", "empty", "nothing"):
        assert got[k].errors == [f"missing_root_field:{f}" for f in quality.ROOT_FIELDS] + ["no_cells_found"] and not got[k].ready_for_nlp
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(given["full"])
    assert quality.document_report(files.document_texts(spark, str(tmp_path / "d")), "file").first().totals.cells == 6


def test_keys_of_maps_go(spark):
    d = spark.sql("""select map('a', named_struct('x', 1, 'y_raw', 2), '_b', named_struct('x', 3, 'y_raw', 4)) as m, array(map('k_raw', 1, 'k', 2)) as l, map(1, map('_z', 1, 'z', cast(null as int))) as n, map('a', named_struct('o_raw', 1)) as gone,
        cast(null as map<string, int>) as none""")
    out = citizen.without_keys(d, citizen.Unwanted(starts=("_",), ends=("_raw",)))
    assert out.columns == ["m", "l", "n", "none"]
    r = out.first().asDict(recursive=True)
    assert r == {"m": {"a": {"x": 1}}, "l": [{"k": 2}], "n": {1: {"z": None}}, "none": None}
    plain = citizen.without_keys(d, lambda name: name.endswith("_raw")).first().asDict(recursive=True)
    assert plain["m"] == {"a": {"x": 1}, "_b": {"x": 3}} and plain["l"] == [{"k_raw": 1, "k": 2}]
    assert citizen.METADATA("bbox") and not citizen.METADATA("raw_text") and citizen.INTERNAL("_columns")


def test_bundle(spark):
    rows = spark.createDataFrame([("Nakuru County", 1, "x", 0.1), ("Nakuru", 2, "y", 0.2), (" ", 3, "z", 0.3)], "county string, idx int, status string, confidence double").withColumn("_note", F.lit("n"))
    none = rows.limit(0)
    reports = spark.createDataFrame([], "file string, tables array<struct<table_id:string,page_number:int,cells:array<struct<row_idx:int,col_idx:int,raw_text:string>>>>")
    r = citizen.bundle({"projects.stalled": rows, "projects.new": none}, reports, "2023-2024", "now").first()
    assert r.projects.stalled.by_county == {"Nakuru": r.projects.stalled.by_county["Nakuru"]} and r.projects.stalled.by_county["Nakuru"].asDict() == {"status": "y"}
    assert (r.projects.new.by_county, r.projects.new.total_counties, r.total_counties, r.metadata.fiscal_year, r.reports) == ({}, 0, 1, "2023-2024", [])
    kept = citizen.bundle({"projects.stalled": rows}, reports, "2023-2024", "now", keep_internal=True).first()
    assert kept.projects.stalled.by_county["Nakuru"].asDict() == {"status": "y", "_note": "n"}


def test_shapes(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0, 0], [1, 0], [1, 1], [0, 1]]
    feature = lambda name, kind, at: {"properties": {"NAME_1": name}, "geometry": {"type": kind, "coordinates": at}}
    given = [feature("a", "Polygon", [square, hole]), feature("b", "MultiPolygon", [[square[::-1]], [[[4, 0], [6, 0], [6, 2], [4, 2]]]]), feature("c", "Point", [1, 2]), feature("d", "Polygon", [[[1, 1], [3, 3]]]), feature("e", "Polygon", []), feature("f", "Polygon", [[], [[5, 5, 100]]])]
    (tmp_path / "m.json").write_text(json.dumps({"features": given}))
    d = files.map_features(spark, str(tmp_path / "m.json"))
    got = {r.county: (r.area, r.x, r.y) for r in maps.centroids(maps.rings(d, ["county"]), ["county"]).collect()}
    assert got == {"a": (3.0, pytest.approx((4 * 1 - 0.5) / 3), pytest.approx((4 * 1 - 0.5) / 3)), "b": (8.0, 3.0, 1.0), "d": (0.0, 2.0, 2.0), "f": (0.0, 5.0, 5.0)}
    places = {r.county: (r.x, r.y) for r in maps.labels(d, ["county"]).collect()}
    assert set(places) == set(got) and all(0 <= x <= 400 and 0 <= y <= 450 for x, y in places.values())
    path = {r.county: r.path for r in maps.outlines(d, ["county"]).collect()}
    assert path["a"].count("M") == path["a"].count("Z") == 2 and path["a"].startswith("M0.0,") and path["b"].count("L") == 6
    assert maps.labels(d.limit(0), ["county"]).count() == 0
    assert spark.range(1).select(G.polygons(F.lit("Polygon"), F.lit("nonsense"))).first()[0] == [None]


def test_names_without_comparing_all(spark):
    import random

    r = random.Random(11)
    name = lambda: "".join(r.choice("ab. ") for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])))
    a = [(r.choice(["f", "g", None]), r.choice([name(), name(), None])) for _ in range(300)]
    b = [(r.choice(["f", "g", "h", None]), r.choice([name(), name(), name(), None])) for _ in range(200)]
    want = {}
    for f, n in a:
        fits = [(x != n, x) for g, x in b if f == g and f and n is not None and x is not None and (n in x or x in n)]
        if fits:
            want[f, n] = min(fits)[1]
    A, B = spark.createDataFrame(a, "folder string, name string"), spark.createDataFrame(b, "folder string, file string")
    rows = annotation.same_name(A, B).collect()
    assert {(x.folder, x.name): x.file for x in rows} == want and len(rows) == len(want)


def test_files_of_annotations_and_tasks(spark, tmp_path):
    box = "filename string, width int, height int, name string, xmin int, ymin int, xmax int, ymax int"
    rows = spark.createDataFrame([("a.png", 100, 50, "table", 10, 10, 30, 20), ("a.png", 100, 50, "stamp", 0, 0, 1, 1), ("b.png", 9, 8, None, None, None, None, None)], box)
    files.write_annotations(rows, str(tmp_path / "all"))
    files.write_annotations(rows, str(tmp_path / "some"), include_empty=False)
    assert sorted(r.filename for r in files.annotations(spark, str(tmp_path / "all"), ("table",)).collect()) == ["a.png", "b.png"]
    assert {r.filename for r in files.annotations(spark, str(tmp_path / "some")).collect()} == {"a.png"}
    got = {r.filename: r for r in annotation.training_boxes(files.annotations(spark, str(tmp_path / "all"), ("table",))).collect()}
    assert (got["a.png"].labels, got["a.png"].orig_size, got["b.png"].boxes) == (["table"], [50, 100], []) and got["a.png"].boxes[0] == pytest.approx([0.2, 0.3, 0.2, 0.2])
    (tmp_path / "pages").mkdir()
    for name in ("r_page_002.png", "r_page_010.jpg", "other.jpeg", "no.txt"):
        (tmp_path / "pages" / name).write_bytes(b"x")
    pages = files.images(spark, str(tmp_path / "pages"))
    assert sorted((r.file, r.report, r.page) for r in pages.collect()) == [("other.jpeg", "other", 0), ("r_page_002.png", "r", 2), ("r_page_010.jpg", "r", 10)]
    files.write_tasks(pages, str(tmp_path / "tasks"), "file")
    tasks = [json.loads(line) for p in (tmp_path / "tasks").glob("*.json") for line in p.read_text().splitlines()]
    assert {t["data"]["image"]: t["data"]["page"] for t in tasks} == {"r_page_002.png": 2, "r_page_010.jpg": 10, "other.jpeg": 0}
    files.write_csv(pages.select("file", "page"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["file", "page"] and back.count() == 3
    files.write_json(pages, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
