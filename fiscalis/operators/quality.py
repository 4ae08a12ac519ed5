"""Plausibility of pages and detections, checks of table cells, levels of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.functions.geometry import area, box
from fiscalis.functions.text import numeric_cell, one_decimal

ENUMERATED = r"^(?:[A-Z]|[IVXLC]+|\d+)[.)]\s+"
TOLERANCE = 2.0


def detection_quality(found: DataFrame, keys: list[str], page_area: int, pages: DataFrame | None = None) -> DataFrame:
    """Per page: detections, 0.8 of the largest and 0.2 of the mean share of the page, plus 0.03 for each up to 0.2; and whether the largest has 1 % of the page.

    With pages (keys), also those without a detection: quality 0, implausible.
    """
    d = found.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(area(box())).alias("covered"), F.max(area(box())).alias("largest"))
    value = 0.8 * (F.col("largest") / page_area) + 0.2 * (F.col("covered") / (F.col("n") * page_area)) + F.least(F.lit(0.2), 0.03 * F.col("n"))
    d = d.select(*keys, "n", value.alias("quality"), (F.col("largest") >= 0.01 * page_area).alias("plausible"))
    if pages is None:
        return d
    known = {"n": F.lit(0), "quality": F.lit(0.0), "plausible": F.lit(False)}
    return pages.select(*keys).distinct().join(d, keys, "left").select(*keys, *(F.coalesce(c, v).alias(c) for c, v in known.items()))


def backup(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Which detector to take per page of first (all pages): the second only where the first is implausible and the second's quality is higher."""
    b = second.select(*keys, F.col("quality").alias("b_quality"))
    better = F.coalesce("b_quality", F.lit(0.0)) > F.col("quality")
    return first.join(b, keys, "left").select(*keys, (~F.col("plausible") & better).alias("use_backup"))


def page_quality(found: DataFrame, keys: list[str], page_area: int, labels: tuple[str, ...] | None = None) -> DataFrame:
    """12 for each table, 8 for its confidence, 30 for its share of the page; of the given labels only, where found has a label."""
    if labels is not None:
        found = found.where(F.col("label").isin(*labels))
    d = found.groupBy(*keys).agg(F.count("*").alias("n_tables"), F.sum("score").alias("confidence_sum"), F.sum(area(box())).alias("covered"))
    d = d.withColumn("share_sum", F.col("covered") / page_area).drop("covered")
    return d.withColumn("model_score", F.round(12 * F.col("n_tables") + 8 * F.col("confidence_sum") + 30 * F.col("share_sum"), 8))


def level(text: Column, col: Column, span: Column) -> Column:
    """The level of a row by its first cell with text: enumerated 1; first column 1 if wide, else 2; second 2; later 3."""
    return F.when(text.rlike(ENUMERATED), 1).when((col == 0) & (span > 1), 1).when(col <= 1, 2).otherwise(3)


def row_levels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The level of each row. cells: keys, row_idx, col_idx, col_span, text."""
    d = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    first = d.groupBy(*keys, "row_idx").agg(F.min_by(F.struct("col_idx", "col_span", "text"), "col_idx").alias("c"))
    return first.select(*keys, "row_idx", level(F.col("c.text"), F.col("c.col_idx"), F.col("c.col_span")).alias("level"))


def row_ratio(row_idx: Column, plain: Column, stated: Column) -> Column:
    """(row_idx, expected, stated) of a row with two plain numbers and a percentage, else null."""
    expected = F.get(plain, F.lit(1)) * 100 / F.nullif(F.get(plain, F.lit(0)), F.lit(0.0))
    return F.when((F.size(plain) >= 2) & stated.isNotNull(), F.struct(row_idx.alias("row_idx"), expected.alias("expected"), stated.alias("stated")))


def checked(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Checks and warnings per table, arrays in a fixed order; a table without warnings is valid.

    cells: keys, row_idx, col_idx, row_span, col_span, text, text_source, level, inside (whether the cell's box meets the
    table's). The ratio is taken from the first row that has two plain numbers and a percentage: second to first number
    against the last percentage, two points apart at most; a first number of 0 can't be checked.
    """
    number, percent = numeric_cell(F.col("text"))
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    d = cells.select(*keys, "row_idx", "col_idx", number.alias("number"), percent.alias("percent"), filled.alias("filled"), "text_source", ((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("merged"), "level", "inside")
    plain = F.transform(F.sort_array(F.collect_list(F.when(F.col("number").isNotNull() & ~F.col("percent"), F.struct("col_idx", "number")))), lambda x: x["number"])
    stated = F.max_by(F.when(F.col("percent"), F.col("number")), F.when(F.col("percent") & F.col("number").isNotNull(), F.col("col_idx")))
    rows = d.groupBy(*keys, "row_idx").agg(
        plain.alias("plain"), stated.alias("stated"), F.bool_or("filled").alias("filled"), F.bool_or(F.col("text_source") == "pdf_text").alias("native"), F.bool_or(F.col("text_source") == "ocr").alias("ocr"),
        F.bool_or("merged").alias("merged"), F.bool_or(F.col("level").isNotNull()).alias("levels"), F.count_if(~F.col("inside")).alias("outside"),
    )
    ratio = row_ratio(F.col("row_idx"), F.col("plain"), F.col("stated"))
    t = rows.groupBy(*keys).agg(
        *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("filled", "native", "ocr", "merged", "levels")), F.sum("outside").alias("outside"), F.min(ratio).alias("r")
    )
    checks, warnings = said(*map(F.col, ("filled", "native", "ocr", "merged", "levels", "outside", "r")))
    return t.select(*keys, checks.alias("checks"), warnings.alias("warnings")).withColumn("is_valid", F.size("warnings") == 0)


def said(filled: Column, native: Column, ocr: Column, merged: Column, levels: Column, outside: Column, r: Column) -> tuple[Column, Column]:
    """The checks and warnings of a table, of what its cells have, of the number outside its box and of the first ratio r (row_idx, expected, stated)."""
    taken = F.coalesce(r["expected"].isNotNull(), F.lit(False))
    off = taken & (F.abs(r["expected"] - r["stated"]) > TOLERANCE)
    checks = [
        (F.lit(True), F.lit("grid_reconstruction")), (filled & native, F.lit("pdf_text_fill")), (filled & ocr, F.lit("ocr_fallback")), (F.lit(True), F.lit("merged_cell_postprocessing")),
        (levels, F.lit("hierarchy_assignment")), (F.lit(True), F.lit("continuation_linking")), (taken, F.lit("numeric_ratio_check")), (outside == 0, F.lit("bounded_boxes")),
    ]
    mismatch = F.concat(F.lit("numeric_ratio_mismatch_row_"), r["row_idx"].cast("string"), F.lit(": expected "), one_decimal(r["expected"]), F.lit(" vs reported "), one_decimal(r["stated"]))
    warnings = [
        (~filled, F.lit("no_cell_text_extracted")), (~merged, F.lit("no_merged_cells_detected")), (~levels, F.lit("no_header_hierarchy_detected")), (off, mismatch),
        (outside > 0, F.concat(outside.cast("string"), F.lit("_cell_boxes_outside_table"))),
    ]
    listed = lambda rules: F.array_compact(F.array(*(F.when(c, x) for c, x in rules)))
    return listed(checks), listed(warnings)


def cell_levels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds hierarchy_level: below the first row, the row's level goes to its first cell with text if that is a header, not in the first column, or enumerated; a merged cell over several rows with text is 1. cells: keys, row_idx, col_idx, row_span, col_span, cell_type, text."""
    found = row_levels(cells, keys).withColumnRenamed("level", "_level")
    text = F.trim(F.coalesce("text", F.lit("")))
    first = F.min(F.when(text != "", F.col("col_idx"))).over(Window.partitionBy(*keys, "row_idx"))
    d = cells.withColumn("_first", first).join(found, [*keys, "row_idx"], "left")
    low = F.col("row_idx") > 0
    own = low & (F.col("col_idx") == F.col("_first")) & (text != "") & ((F.col("cell_type") == "header") | (F.col("_first") > 0) | text.rlike(ENUMERATED))
    value = F.when(low & (F.col("row_span") > 1) & (text != ""), 1).when(own, F.col("_level"))
    return d.withColumn("hierarchy_level", value.cast("int")).drop("_first", "_level")


#: The fields that a hand-off document and each of its tables have.
ROOT_FIELDS = ("document_id", "source_file", "page_count", "processed_at", "model_version", "tables")
TABLE_FIELDS = ("table_id", "page_number", "bbox", "grid", "continuation", "cells", "validation")


def document_report(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The checks of hand-off documents as they come, whose fields may be missing: (key, totals, warnings, errors, checks, ready_for_nlp) for each.

    Documents are parsed as variants, so a missing field differs from a null one. Errors: missing fields of the document in
    a fixed order, then those of its tables in their order with the table's id (unknown if it has none), then that there is
    no cell. Warnings: over 40 % of the cells without text, over 30 % of a confidence under 0.5. What a cell doesn't state
    counts as no text, spans of 1 and a confidence of 1. A text that is no object lacks all fields. A document is counted
    where its text is, in the one row that holds it anyway: nothing is moved, and nothing parsed twice.
    """
    v = F.try_parse_json(F.col(text))
    d = texts.select(key, v.alias("v"))
    lacks = lambda of, fields, error: F.filter(F.array(*(F.when(F.try_variant_get(of, f"$.{f}", "variant").isNull(), error(f)) for f in fields)), lambda e: e.isNotNull())
    told = lambda of, path, kind: F.try_variant_get(of, f"$.{path}", kind)
    root = d.select(key, lacks(F.col("v"), ROOT_FIELDS, lambda f: F.lit(f"missing_root_field:{f}")).alias("_root"), F.coalesce(told(F.col("v"), "tables", "array<variant>"), F.array().cast("array<variant>")).alias("_tables"))
    over = lambda c, span: F.coalesce(told(c, span, "double"), F.lit(1.0)) > 1
    some_cells = lambda t: F.coalesce(told(t, "cells", "array<variant>"), F.array().cast("array<variant>"))
    tests = {
        "empty_text_cells": lambda c: F.trim(F.coalesce(told(c, "raw_text", "string"), F.lit(""))) == "", "ocr_cells": lambda c: F.coalesce(told(c, "text_source", "string") == "ocr", F.lit(False)),
        "merged_cells": lambda c: over(c, "row_span") | over(c, "col_span"), "low_conf_cells": lambda c: F.coalesce(told(c, "confidence", "double"), F.lit(1.0)) < 0.5,
    }
    counted = ("cells", "empty_text_cells", "ocr_cells", "continuation_tables", "merged_cells", "low_conf_cells")
    flags = F.transform(F.flatten(F.transform("_tables", some_cells)), lambda c: F.struct(*(test(c).alias(name) for name, test in tests.items())))
    yes = lambda t, path: F.coalesce(told(t, f"continuation.{path}", "boolean"), F.lit(False))
    name = lambda t: F.coalesce(told(t, "table_id", "string"), F.lit("unknown"))
    lacking = F.flatten(F.transform("_tables", lambda t: lacks(t, TABLE_FIELDS, lambda f: F.concat(name(t), F.lit(f":missing_table_field:{f}")))))
    linked = F.filter("_tables", lambda t: yes(t, "is_continuation") | yes(t, "continues_on_next_page"))
    d = root.select(key, "_root", F.size("_tables").cast("long").alias("tables"), flags.alias("_flags"), F.size(linked).cast("long").alias("continuation_tables"), lacking.alias("_errors"))
    n = lambda name: F.size(F.filter("_flags", lambda c: c[name])).cast("long").alias(name)
    d = d.select(key, "_root", "tables", F.size("_flags").cast("long").alias("cells"), "continuation_tables", "_errors", *map(n, tests))
    some = F.col("cells") > 0
    blank, unsure = (some & (F.col(c) / F.col("cells") > part) for c, part in (("empty_text_cells", 0.4), ("low_conf_cells", 0.3)))
    errors = F.concat("_root", "_errors", F.when(some, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_cells_found"))))
    return d.select(
        key, F.struct("tables", *counted).alias("totals"), F.array_compact(F.array(F.when(blank, F.lit("high_empty_text_ratio")), F.when(unsure, F.lit("high_low_confidence_cell_ratio")))).alias("warnings"), errors.alias("errors"),
        F.struct((F.size("_root") == 0).alias("has_root_fields"), some.alias("has_cells"), (~blank).alias("text_coverage_ok"), (~unsure).alias("confidence_coverage_ok")).alias("checks"), (F.size(errors) == 0).alias("ready_for_nlp"),
    )
