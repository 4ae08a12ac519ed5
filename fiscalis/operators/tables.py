"""Detected tables: words in cells, grids, clusters, plausibility, linking across pages, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from fiscalis.functions.geometry import box, iou, meets, overlap
from fiscalis.functions.text import rounded

LINK = 0.82


#: Pairs of a page up to which it isn't cut into tiles, and tiles of a page along one side at most.
FEW_PAIRS = 4096
MOST_TILES = 1024
SIDES = ("x1", "y1", "x2", "y2")


def _page_tiles(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per page with boxes on both sides its corner, the number of tiles along a side and their width and height; a page has about one tile for every four boxes of its larger side."""
    side = lambda d, mine: d.select(*keys, *SIDES, F.lit(mine).alias("_mine"))
    found = side(a, True).unionByName(side(b, False)).groupBy(*keys).agg(
        F.count_if("_mine").alias("_a"), F.count_if(~F.col("_mine")).alias("_b"), F.min("x1").alias("_x"), F.min("y1").alias("_y"), (F.max("x2") - F.min("x1")).alias("_w"), (F.max("y2") - F.min("y1")).alias("_h")
    )
    many = F.least(F.lit(MOST_TILES), F.ceil(F.sqrt(F.greatest("_a", "_b")) / 2))
    found = found.where("_a > 0 and _b > 0").withColumn("_g", F.when(F.col("_a") * F.col("_b") <= FEW_PAIRS, 1).otherwise(many).cast("int"))
    return found.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_x", "_y", "_g", (F.col("_w") / F.col("_g")).alias("_w"), (F.col("_h") / F.col("_g")).alias("_h"))


def _dense(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether some page has more than FEW_PAIRS pairs."""
    side = lambda d, mine: d.select(*keys, F.lit(mine).alias("_mine"))
    n = side(a, True).unionByName(side(b, False)).groupBy(*keys).agg(F.count_if("_mine").alias("_a"), F.count_if(~F.col("_mine")).alias("_b"))
    return (n.agg(F.max(F.col("_a") * F.col("_b"))).first()[0] or 0) > FEW_PAIRS


def _tile(at: Column, start: str, step: str) -> Column:
    return F.least(F.floor((at - F.col(start)) / F.col(step)).cast("int"), F.col("_g") - 1)


def meeting(a: DataFrame, b: DataFrame, keys: list[str], dense: bool | None = None) -> DataFrame:
    """The pairs of boxes of a and b on one page that share some area: a's columns and b's, prefixed b_. keys may be null on both sides; boxes without area, or with a null side, meet none.

    dense says whether pages may have many boxes; None: they are counted first. If not, boxes are joined by page alone. Else each page with many boxes is cut into tiles. A box goes to all tiles that it touches, boxes meet within a tile, and a pair
    is given out by the tile that holds the upper left corner of what it shares, so once. A dense page is dealt to many tasks.
    """
    solid = lambda d: d.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    a, b = solid(a), solid(b)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    for low, high in (("x1", "x2"), ("y1", "y2")):
        on = on & (F.col(low) < F.col(f"b_{high}")) & (F.col(f"b_{low}") < F.col(high))
    named = [F.col(c).alias(f"b_{c}") for c in b.columns]
    if not (_dense(a, b, keys) if dense is None else dense):
        return a.join(b.select(*named), on)
    page = _page_tiles(a, b, keys)

    def dealt(d: DataFrame, x: str, y: str) -> DataFrame:
        at = F.lit(True)
        for k in keys:
            at = at & d[k].eqNullSafe(F.col(f"_k_{k}"))
        reach = lambda low, high, start, step: F.explode(F.sequence(_tile(F.col(low), start, step), _tile(F.col(high), start, step)))
        d = d.join(page, at).withColumn(x, reach("x1", "x2", "_x", "_w")).withColumn(y, reach("y1", "y2", "_y", "_h"))
        return d.drop(*(f"_k_{k}" for k in keys))

    left = dealt(a, "_tx", "_ty")
    right = dealt(b, "_bx", "_by").select("_bx", "_by", *named)
    on = on & (F.col("_tx") == F.col("_bx")) & (F.col("_ty") == F.col("_by"))
    own = (_tile(F.greatest("x1", "b_x1"), "_x", "_w") == F.col("_tx")) & (_tile(F.greatest("y1", "b_y1"), "_y", "_h") == F.col("_ty"))
    return left.join(right, on & own).select(*a.columns, *(f"b_{c}" for c in b.columns))


def pairs(a: DataFrame, b: DataFrame, keys: list[str], least: float, dense: bool | None = None) -> DataFrame:
    """Boxes of a and b on one page with at least that IoU (over 0): a's rows and b's (prefixed b_), and iou; dense as in meeting()."""
    if least <= 0:
        raise ValueError("least must be over 0")
    return meeting(a, b, keys, dense).withColumn("iou", iou(box(), box("b_"))).where(F.col("iou") >= least)


def words_in_cells(words: DataFrame, cells: DataFrame, keys: list[str], cell_id: str, least: float = 0.2) -> DataFrame:
    """The text of each cell: the words that lie in it by at least that part (over 0) of the smaller area, in rows from top to bottom, then from the left; blank words are left out."""
    told = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(*keys, "word_idx", "text", *SIDES)
    hit = meeting(told, cells.select(*keys, cell_id, *SIDES), keys).where(overlap(box(), box("b_")) >= least)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.round("y1", 1).alias("y"), "x1", "word_idx", "text"))), lambda w: w["text"]), " ")
    return hit.groupBy(*keys, F.col(f"b_{cell_id}").alias(cell_id)).agg(F.count("*").alias("n_words"), text.alias("text"))


def gap_clusters(items: DataFrame, keys: list[str], centre: str, threshold: Column, order: str) -> DataFrame:
    """Adds a cluster number per key: a new cluster starts where the gap to the previous item is over the threshold."""
    w = Window.partitionBy(*keys).orderBy(centre, order)
    new = F.coalesce((F.col(centre) - F.lag(centre).over(w) > threshold).cast("int"), F.lit(0))
    return items.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def hulls(items: DataFrame, keys: list[str], *kept: str) -> DataFrame:
    """The box around each cluster and its score by the number of items; kept are columns that have one value per key."""
    return items.groupBy(*keys, "cluster").agg(
        *(F.max(c).alias(c) for c in kept),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"),
        F.least(F.lit(1.0), 0.5 + F.count("*") / 20).alias("score"),
    )


def upper_median(column: str | Column) -> Column:
    """Of n values in order, the one at n / 2, counted from 0."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def grid(rows: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """The cells where rows and columns of a table cross, without degenerate ones."""
    r = rows.select(*keys, F.col("idx").alias("row_idx"), F.col("y1"), F.col("y2"), F.col("score").alias("row_score"))
    c = columns.select(*keys, F.col("idx").alias("col_idx"), F.col("x1"), F.col("x2"), F.col("score").alias("col_score"))
    return r.join(c, keys).where("x2 > x1 and y2 > y1").select(
        *keys, "row_idx", "col_idx", "x1", "y1", "x2", "y2", F.round((F.col("row_score") + F.col("col_score")) / 2, 4).alias("confidence"),
        F.when(F.col("row_idx") == 0, "column_header").otherwise("data").alias("cell_type"),
    )


#: Boxes that are folded at once.
BLOCK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept(b: Column, kind: str | DataType, most: float = 0.7) -> Column:
    """Of an array of boxes (c, o, sides, score) in the order of their centres those that stay: one that overlaps the last kept by `most` takes its place if its score is higher, else goes. kind: the type of a box.

    The fold holds the last kept box alone and says of each box whether it goes, stays or takes the last one's place, a
    block of boxes at a time; a box is kept if it stays and the next one that stays doesn't take its place.
    """
    side = lambda s: tuple(s[k] for k in SIDES)
    none, said = F.lit(None).cast(kind), F.array().cast("array<int>")
    GOES, STAYS, REPLACES = 0, 1, 2

    clash = lambda a, x: meets(side(a), side(x)) & (overlap(side(a), side(x)) >= most)

    def step(s: Column, x: Column) -> Column:
        last = s["last"]
        what = F.when(F.coalesce(last.isNotNull() & clash(last, x), F.lit(False)), F.when(x["score"] > last["score"], REPLACES).otherwise(GOES)).otherwise(STAYS)
        return once(what, lambda what: F.struct(F.when(what == GOES, last).otherwise(x).alias("last"), F.concat(s["said"], F.array(what)).alias("said")))

    def block(s: Column, i: Column) -> Column:
        found = F.aggregate(F.slice(b, i * BLOCK + 1, F.lit(BLOCK)), F.struct(s["last"].alias("last"), said.alias("said")), step)
        return once(found, lambda f: F.struct(f["last"].alias("last"), F.concat(s["said"], F.array(f["said"])).alias("said")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(b) - 1) / BLOCK).cast("int"))
    folded = F.aggregate(blocks, F.struct(none.alias("last"), F.array().cast("array<array<int>>").alias("said")), block, lambda s: F.flatten(s["said"]))
    left = F.filter(F.zip_with(b, folded, lambda x, what: F.struct(x.alias("x"), what.alias("what"))), lambda p: p["what"] != GOES)
    stay = once(left, lambda ps: F.transform(F.filter(ps, lambda p, i: F.coalesce(F.get(ps, i + 1)["what"], F.lit(STAYS)) != REPLACES), lambda p: p["x"]))
    # boxes of which none clashes with the one before it all stay
    some = F.exists(F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), lambda a, x: clash(a, x)), lambda c: c)
    return F.when(F.coalesce(some, F.lit(False)), stay).otherwise(b)


def kept_boxes(boxes: DataFrame, keys: list[str], centre: str, order: str, most: float = 0.7) -> DataFrame:
    """The boxes of each key that stay, by the rule of kept()."""
    item = F.struct(F.col(centre).alias("c"), F.col(order).alias("o"), *SIDES, F.col("score").cast("double").alias("score"))
    each = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("b"))
    return each.select(*keys, F.inline(kept(F.col("b"), each.schema["b"].dataType.elementType, most))).withColumnsRenamed({"c": centre, "o": order})


def resampled(v: Column, n: Column | int) -> Column:
    """A vector of n values by linear interpolation; zeros for an empty one, the first value for n = 1."""
    n = F.lit(n) if isinstance(n, int) else n

    def at(i: Column) -> Column:
        x = F.when(n > 1, i * (F.size(v) - 1) / (n - 1)).otherwise(F.lit(0.0))
        return once(x, lambda x: once(F.floor(x).cast("int"), lambda low: once(x - low, lambda part: between(low, part))))

    def between(low: Column, part: Column) -> Column:
        return F.coalesce(F.get(v, low).cast("double") * (1 - part) + F.get(v, F.least(low + 1, F.size(v) - 1)).cast("double") * part, F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, the shorter filled with zeros; 0 if one has no length."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + zero(x) * zero(x))

    def likeness(a: Column, b: Column) -> Column:
        dot = total(F.zip_with(a, b, lambda x, y: zero(x) * zero(y)))
        return once(F.sqrt(square(a)) * F.sqrt(square(b)), lambda size: F.when(size > 0, dot / size).otherwise(F.lit(0.0)))

    return once(a, lambda a: once(b, lambda b: likeness(a, b)))


def continuation_score(profile: Column, other: Column, width: Column, other_width: Column, x: Column, other_x: Column) -> Column:
    """0.7 likeness of columns, brought to the shorter profile's length (3 at least), 0.2 of widths, 0.1 of left edges."""
    same = lambda v, n: F.when(F.size(v) == n, F.transform(v, lambda y: y.cast("double"))).otherwise(resampled(v, n))
    alike = once(F.greatest(F.lit(3), F.least(F.size(profile), F.size(other))), lambda n: cosine(same(profile, n), same(other, n)))
    widest = F.greatest(width, other_width)
    wide = F.greatest(F.lit(0.0), 1 - F.abs(width - other_width) / widest)
    shift = F.greatest(F.lit(0.0), 1 - F.abs(x - other_x) / widest)
    return 0.7 * alike + 0.2 * wide + 0.1 * shift


def continuations(tables: DataFrame, keys: list[str], least: float = LINK) -> DataFrame:
    """Each table with its links: continues_from is the best one on the page before if its score reaches `least` (equals go to the lower index); linked is the last table of the next page that continues this one; match_score is that one's score, else its own.

    Tables without a profile are not linked. tables: keys, page, idx, profile, width, x.
    """
    own = tables.withColumn("width", F.greatest("width", F.lit(1)))
    before = own.select(*keys, (F.col("page") + 1).alias("page"), *[F.col(c).alias(f"p_{c}") for c in ("idx", "profile", "width", "x")])
    score = continuation_score(F.col("profile"), F.col("p_profile"), F.col("width"), F.col("p_width"), F.col("x"), F.col("p_x"))
    scored = own.join(before, [*keys, "page"]).where((F.size("profile") > 0) & (F.size("p_profile") > 0)).withColumn("score", score)
    best = scored.groupBy(*keys, "page", "idx").agg(F.max(F.struct("score", (-F.col("p_idx")).alias("back"))).alias("b")).where(F.col("b.score") >= least)
    best = best.select(*keys, "page", "idx", (-F.col("b.back")).alias("continues_from"), F.col("b.score").alias("score"))
    claimed = best.groupBy(*keys, (F.col("page") - 1).alias("page"), F.col("continues_from").alias("idx")).agg(F.max(F.struct(F.col("idx").alias("linked"), "score")).alias("c"))
    d = tables.select(*keys, "page", "idx").join(best, [*keys, "page", "idx"], "left").join(claimed, [*keys, "page", "idx"], "left")
    return d.select(*keys, "page", "idx", "continues_from", F.col("c.linked").alias("linked"), F.round(F.coalesce("c.score", "score"), 4).alias("match_score"))


def page_links(own: Column, before: Column, behind: Column, least: float = LINK) -> Column:
    """continuations() for the tables of one page, given with those of the pages before and behind as arrays (idx, profile, width, x): an array (idx, continues_from, linked, match_score)."""

    def best(x: Column, others: Column) -> Column:
        wide = lambda t: F.greatest(t["width"], F.lit(1.0))
        score = lambda y: continuation_score(x["profile"], y["profile"], wide(x), wide(y), x["x"], y["x"])
        met = F.filter(others, lambda y: (F.size(x["profile"]) > 0) & (F.size(y["profile"]) > 0))
        return once(F.array_max(F.transform(met, lambda y: F.struct(score(y).alias("score"), (-y["idx"]).alias("back")))), lambda b: F.when(b["score"] >= least, b))

    first = F.transform(own, lambda x: F.struct(x["idx"].alias("idx"), best(x, before).alias("b")))
    claims = F.filter(F.transform(behind, lambda x: F.struct(x["idx"].alias("idx"), best(x, own).alias("b"))), lambda c: c["b"].isNotNull())

    def link(t: Column, claims: Column) -> Column:
        claimed = F.array_max(F.transform(F.filter(claims, lambda c: c["b"]["back"] == -t["idx"]), lambda c: F.struct(c["idx"].alias("linked"), c["b"]["score"].alias("score"))))
        return once(claimed, lambda c: F.struct(t["idx"].alias("idx"), (-t["b"]["back"]).alias("continues_from"), c["linked"].alias("linked"), F.round(F.coalesce(c["score"], t["b"]["score"]), 4).alias("match_score")))

    return once(claims, lambda claims: F.transform(first, lambda t: link(t, claims)))


def profile(starts: Column, ends: Column) -> Column:
    """Each column's part of the width of all, a column one unit wide at least."""
    wide = F.zip_with(starts, ends, lambda a, b: F.greatest(b - a, F.lit(1)).cast("double"))
    total = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)
    return F.transform(wide, lambda x: rounded(x / total, 6))


def missing_fields(json: Column, required: tuple[str, ...]) -> Column:
    """The required keys that a JSON object lacks, in their order."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def quality_totals(cells: DataFrame, tables: DataFrame | None = None, errors: int = 0) -> DataFrame:
    """Counts over all cells of one document (of several: quality.document_report) and whether too many are empty (over 40 %) or uncertain (over 30 % under 0.5; a missing confidence is 1). cells: table_id, raw_text, text_source, row_span, col_span, confidence; tables: table_id, is_continuation, continues_on_next_page."""
    found = cells.agg(
        F.count_distinct("table_id").alias("tables"), F.count("*").alias("cells"), F.count_if(F.trim(F.coalesce("raw_text", F.lit(""))) == "").alias("empty_text"), F.count_if(F.col("text_source") == "ocr").alias("ocr"),
        F.count_if((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("merged"), F.count_if(F.coalesce("confidence", F.lit(1.0)) < 0.5).alias("low_confidence"),
    )
    if tables is not None:
        linked = F.coalesce("is_continuation", F.lit(False)) | F.coalesce("continues_on_next_page", F.lit(False))
        found = found.drop("tables").join(tables.agg(F.count("*").alias("tables"), F.count_if(linked).alias("continuations")))  # one row each
    low = F.col("cells") > 0
    return (
        found.withColumn("empty_warning", F.col("empty_text") > 0.4 * F.col("cells")).withColumn("confidence_warning", F.col("low_confidence") > 0.3 * F.col("cells")).withColumn("ready", low & F.lit(errors == 0))
    )
