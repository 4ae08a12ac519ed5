"""From a detector's boxes to the tables of a page: tiny boxes replaced, a second detector as a fallback, implausible boxes dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.functions.geometry import area, box, centre_distance, clamped, iou, plausible, tiny
from fiscalis.functions.text import cell_id
from fiscalis.operators.quality import backup, detection_quality
from fiscalis.operators.tables import SIDES

#: Score of a box that no detector gave, and the least part of the page that a table has.
INJECTED = 0.55
LEAST_SHARE = 0.001


def stabilised(found: DataFrame, candidates: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Detections cut to the page; a tiny one takes the box of the page's own candidate that it overlaps most (the earlier of equals), or, if it meets none, of the one whose centre is nearest. A page with candidates but no detection gets them all as tables.

    found: keys, idx, label, score, box; candidates: keys, idx, box. A page without candidates keeps its boxes. Only tiny
    boxes meet candidates, and only those of their page. Adds injected, and raw_x1 to raw_y2 as they were (null if injected).
    """
    w, h = F.lit(width), F.lit(height)
    names = ("x1", "y1", "x2", "y2")
    cut = lambda prefix="": [c.cast("double").alias(n) for c, n in zip(clamped(box(prefix), w, h), names)]
    cand = candidates.select(*keys, F.col("idx").alias("c_idx"), *cut()).withColumnsRenamed({n: f"c_{n}" for n in names})
    own = found.select(*keys, "idx", "label", "score", *(F.col(n).alias(f"raw_{n}") for n in names), *cut())
    small = tiny(box(), w, h)
    meet = own.where(small).select(*keys, "idx", *names).join(cand, keys)
    overlap = iou(box(), box("c_"))
    best = meet.groupBy(*keys, "idx").agg(F.min(F.struct((-overlap).alias("o"), F.when(overlap > 0, 0.0).otherwise(centre_distance(box(), box("c_"))).alias("d"), "c_idx", *(f"c_{n}" for n in names))).alias("b"))
    kept = own.join(best, [*keys, "idx"], "left")
    out = [F.round(F.coalesce(F.col(f"b.c_{n}"), F.col(n)), 1).alias(n) for n in names]
    kept = kept.select(*keys, "idx", "label", "score", *(f"raw_{n}" for n in names), *out, F.lit(False).alias("injected"))
    more = cand.join(found.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.col("c_idx").alias("idx"), F.lit("table").alias("label"), F.lit(INJECTED).alias("score"), *(F.lit(None).cast(kept.schema[f"raw_{n}"].dataType).alias(f"raw_{n}") for n in names),
        *(F.round(f"c_{n}", 1).alias(n) for n in names), F.lit(True).alias("injected"),
    )
    return kept.unionByName(more.select(kept.columns))


def final(pages: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """The tables of each page: the first detector's boxes, or the second's where the first's are implausible and the second's are better; without boxes that can't be tables. Both as stabilised() gives them; pages: keys."""
    size = width * height
    a, b = (detection_quality(d, keys, size, pages) for d in (first, second))
    use = backup(a, b, keys)
    d = first.join(use.where("not use_backup"), keys, "left_semi").unionByName(second.join(use.where("use_backup"), keys, "left_semi"))
    raw = tuple(F.coalesce(F.col(f"raw_{n}"), F.col(n)) for n in ("x1", "y1", "x2", "y2"))
    keep = (area(box()) >= LEAST_SHARE * size) & plausible(raw, F.lit(width), F.lit(height))
    return d.where(keep).drop("raw_x1", "raw_y1", "raw_x2", "raw_y2")


#: Warnings of a table of which only the box is known.
ONLY_DETECTED = ("structure_recognition_not_run", "cell_extraction_not_run", "post_processing_not_run")


def only_detected(found: DataFrame, page: str = "page_number", order: str = "idx", doc: str = "document_id") -> DataFrame:
    """Table entries of pages whose structure isn't known: no cells, and three fixed warnings. Tables are numbered on their page, pages of several documents (column doc) apart."""
    on_page = [doc, page] if doc in found.columns else [page]
    at = F.row_number().over(Window.partitionBy(*on_page).orderBy(order)) - 1
    return found.withColumn("table_id", cell_id(F.col(page), at)).select(
        *on_page[:-1], "table_id", page, "label", "score", *SIDES, F.lit(0).alias("n_rows"), F.lit(0).alias("n_cols"), F.lit(False).alias("is_valid"), F.array(*map(F.lit, ONLY_DETECTED)).alias("warnings")
    )
