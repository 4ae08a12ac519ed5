"""Cell grids with spans: rows, columns and spanning boxes of a detected table become cells with places, types and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.functions.geometry import box, holds_centre, meets, overlap
from fiscalis.functions.text import cell_id, numeric_cell
from fiscalis.operators.lineage import cut, parts_of
from fiscalis.operators.quality import ENUMERATED, cell_levels, level, row_ratio, said
from fiscalis.operators.tables import SIDES, gap_clusters, grid, hulls, kept, kept_boxes, meeting, once, page_links, profile, words_in_cells

HIT = 0.25
#: Checks and warnings of a table without a cell.
BARE_CHECKS = ("merged_cell_postprocessing", "continuation_linking", "bounded_boxes")
BARE_WARNINGS = ("empty_grid", "no_cell_text_extracted", "no_merged_cells_detected", "no_header_hierarchy_detected")


def hits(segments: DataFrame, spans: DataFrame, keys: list[str], least: float = HIT) -> DataFrame:
    """(keys, span_idx, idx): the rows (or columns) of a table that a spanning box overlaps by at least that part of the smaller area. Both: keys, box; segments: idx, spans: span_idx."""
    met = meeting(segments.select(*keys, "idx", *SIDES), spans.select(*keys, "span_idx", *SIDES), keys)
    return met.where(overlap(box(), box("b_")) >= least).select(*keys, F.col("b_span_idx").alias("span_idx"), "idx")


def merged(rows: DataFrame, columns: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span_idx, r, c, row_span, col_span, row_hits, col_hits): spans that meet a row and a column; r and c are the first of these, the spans their numbers."""
    take = lambda d, name: hits(d, spans, keys).groupBy(*keys, "span_idx").agg(F.array_sort(F.collect_set("idx")).alias(name))
    d = take(rows, "row_hits").join(take(columns, "col_hits"), [*keys, "span_idx"])
    return d.select(*keys, "span_idx", F.array_min("row_hits").alias("r"), F.array_min("col_hits").alias("c"), F.size("row_hits").alias("row_span"), F.size("col_hits").alias("col_span"), "row_hits", "col_hits")


def covered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The slots that a span covers behind its first one."""
    slots = F.flatten(F.transform("row_hits", lambda r: F.transform("col_hits", lambda c: F.struct(r.alias("row_idx"), c.alias("col_idx")))))
    rest = F.array_except(slots, F.array(F.struct(F.col("r").alias("row_idx"), F.col("c").alias("col_idx"))))
    return spans.select(*keys, F.explode(rest).alias("s")).select(*keys, "s.*").distinct()


def cells(rows: DataFrame, columns: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """All crossings of rows and columns that no span covers; the first span with that place gives a cell its spans. Cells of the first row are column headers, other merged ones headers, the rest data.

    rows, columns: keys, idx, box, score; spans: keys, span_idx, box. Tables without rows or columns have no cells.
    """
    m = merged(rows, columns, spans, keys)
    own = m.groupBy(*keys, F.col("r").alias("row_idx"), F.col("c").alias("col_idx")).agg(F.min_by(F.struct("row_span", "col_span"), "span_idx").alias("m"))
    d = grid(rows, columns, keys).join(covered(m, keys), [*keys, "row_idx", "col_idx"], "left_anti").join(own, [*keys, "row_idx", "col_idx"], "left")
    kind = F.when(F.col("row_idx") == 0, "column_header").when(F.col("m").isNotNull(), "header").otherwise("data")
    return d.select(
        *keys, "row_idx", "col_idx", F.coalesce("m.row_span", F.lit(1)).alias("row_span"), F.coalesce("m.col_span", F.lit(1)).alias("col_span"), kind.alias("cell_type"), "x1", "y1", "x2", "y2", "confidence"
    )


def preferred_text(*sources: tuple[str, Column]) -> Column:
    """The first text that isn't blank, with the name of its source; none gives an empty text of source none."""
    pick = F.lit(None).cast("struct<text:string,text_source:string>")
    for name, text in reversed(sources):
        pick = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.struct(F.trim(text).alias("text"), F.lit(name).alias("text_source"))).otherwise(pick)
    return F.coalesce(pick, F.struct(F.lit("").alias("text"), F.lit("none").alias("text_source")))


def with_ids(found: DataFrame, page: str = "page_number", table: str = "table_idx") -> DataFrame:
    return found.withColumn("cell_id", cell_id(F.col(page), F.col(table), F.col("row_idx"), F.col("col_idx")))


def page_keys(tables: DataFrame, page: str = "page_number", doc: str = "document_id") -> list[str]:
    """What tells a page: its number, and its document where tables have one."""
    return [doc, page] if doc in tables.columns else [page]


def build(tables: DataFrame, rows: DataFrame, columns: DataFrame, spans: DataFrame, words: DataFrame, read: DataFrame, keys: list[str], page: str = "page_number", table: str = "table_idx", doc: str = "document_id") -> DataFrame:
    """The cells of detected tables with ids, text, levels: grid with spans, the page's own words (20 % of the smaller area) before read ones (15 %).

    tables: keys, page, table (number on the page), box, and doc, where they are of several documents; rows, columns,
    spans: keys and boxes from the table's corner; words, read: doc, page, word_idx, text, box on the page. keys tell a
    table from those of all documents.
    """
    on_page = page_keys(tables, page, doc)
    own = [*keys, *(c for c in (*on_page, table) if c not in keys)]
    corner = tables.select(*own, F.col("x1").alias("_x"), F.col("y1").alias("_y"))
    d = cells(rows, columns, spans, keys).join(corner, keys)
    d = d.select(*own, "row_idx", "col_idx", "row_span", "col_span", "cell_type", "confidence", *((F.col(c) + F.col(o)).alias(c) for c, o in (("x1", "_x"), ("y1", "_y"), ("x2", "_x"), ("y2", "_y"))))
    d = cut(with_ids(d, page, table))  # read several times below
    texts = lambda w, name, least: words_in_cells(w, d, on_page, "cell_id", least).select(*on_page, "cell_id", F.col("text").alias(name))
    for found in (texts(words, "_native", 0.2), texts(read, "_read", 0.15)):
        d = d.join(found, [*on_page, "cell_id"], "left")
    d = d.withColumn("_t", preferred_text(("pdf_text", F.col("_native")), ("ocr", F.col("_read"))))
    return cell_levels(d.select(*own, *(c for c in d.columns if c not in own and not c.startswith("_")), "_t.*"), keys)


def segments_of_words(words: DataFrame, tables: DataFrame, keys: list[str], down: bool, page: str = "page_number", doc: str = "document_id") -> DataFrame:
    """Rows (down) or columns of tables from the words whose centres lie in them: clusters of centres with gaps of at most 1.7 median heights (6 at least), or 2.5 median widths (30 at least), each as wide or as high as its table.

    words: page, word_idx, text, box; tables: keys, page, box; both with doc, where they are of several documents. Gives
    keys, idx, box, score. A page's words meet its tables by tiles, as do other boxes.
    """
    on_page = page_keys(tables, page, doc)
    t = tables.select(*keys, *(c for c in on_page if c not in keys), *SIDES)
    w = words.where(F.coalesce("text", F.lit("")) != "")
    # a word whose centre is in a table meets it, unless it has no area or only touches: so its centre is looked for, as a very small box
    wide, high = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    dots = w.select(*on_page, "word_idx", *(F.col(c).alias(f"w_{c}") for c in SIDES), (wide - 1e-6).alias("x1"), (high - 1e-6).alias("y1"), (wide + 1e-6).alias("x2"), (high + 1e-6).alias("y2"))
    w = meeting(dots, t, on_page).where(holds_centre(box("b_"), box("w_")))
    w = w.select(*(F.col(f"b_{k}").alias(k) for k in keys), "word_idx", *(F.col(f"w_{c}").alias(c) for c in SIDES), *(F.col(f"b_{c}").alias(f"t_{c}") for c in SIDES))
    low, high, least, times = ("y1", "y2", 6.0, 1.7) if down else ("x1", "x2", 30.0, 2.5)
    # words are dealt by table once, with the table's box, in as many parts as tables ask for; the median, the clusters and their hulls are made where they are
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_of(tables))
    of = Window.partitionBy(*keys)
    w = w.dropna(subset=keys).repartition(parts, *keys).withColumn("_size", F.col(high) - F.col(low)).withColumn("_rank", F.row_number().over(of.orderBy("_size"))).withColumn("_n", F.count("*").over(of))
    median = F.max(F.when(F.col("_rank") == F.floor(F.col("_n") / 2) + 1, F.col("_size"))).over(of)  # the upper one
    w = w.withColumn("gap", F.greatest(F.lit(least), median * times)).withColumn("centre", (F.col(low) + F.col(high)) / 2)
    sides = [f"t_{c}" for c in SIDES]
    d = hulls(gap_clusters(w, keys, "centre", F.col("gap"), "word_idx"), keys, *sides)
    box_ = ("t_x1", "y1", "t_x2", "y2") if down else ("x1", "t_y1", "x2", "t_y2")
    return d.select(*keys, F.col("cluster").cast("int").alias("idx"), *(F.col(c).alias(n) for c, n in zip(box_, SIDES)), "score")


def enough(found: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """The segments that a model found; for tables with fewer than two of them the inferred ones, where these are more. Both: keys, idx, box, score."""
    count = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    n = count(found, "_f").join(count(inferred, "_i"), keys, "full_outer").select(*keys, (F.coalesce("_f", F.lit(0)) < F.least(F.lit(2), F.coalesce("_i", F.lit(0)))).alias("_use"))
    return found.join(n.where("not _use"), keys, "left_semi").unionByName(inferred.join(n.where("_use"), keys, "left_semi"))


def whole(found: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """The segments, and for tables without any one that is the whole table, of score 0. found: keys, idx, box from the table's corner, score."""
    zero, wide, high = F.lit(0.0), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    bare = tables.join(found.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("idx"), zero.alias("x1"), zero.alias("y1"), wide.cast("double").alias("x2"), high.cast("double").alias("y2"), zero.alias("score"))
    return found.select(*keys, "idx", *(F.col(c).cast("double").alias(c) for c in (*SIDES, "score"))).unionByName(bare)


def segments(found: DataFrame, words: DataFrame, tables: DataFrame, keys: list[str], down: bool) -> DataFrame:
    """The rows (down) or columns of tables, numbered from 0 in their order: the model's without those that overlap others, the words' where that leaves fewer than two, else the whole table. found: keys, idx, box from the table's corner, score."""
    low, high = ("y1", "y2") if down else ("x1", "x2")
    centred = lambda d: d.withColumn("_c", (F.col(low) + F.col(high)) / 2)
    own = kept_boxes(centred(found), keys, "_c", "idx").drop("_c")
    corner = tables.select(*keys, F.col("x1").alias("_x"), F.col("y1").alias("_y"))
    inferred = segments_of_words(words, tables, keys, down).join(corner, keys)
    inferred = inferred.select(*keys, "idx", *((F.col(c) - F.col(o)).alias(c) for c, o in zip(SIDES, ("_x", "_y", "_x", "_y"))), "score")
    double = lambda d: d.select(*keys, F.col("idx").cast("int").alias("idx"), *(F.col(c).cast("double").alias(c) for c in (*SIDES, "score")))
    d = whole(cut(enough(cut(double(own)), cut(double(inferred)), keys)), tables, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_c", "idx")) - 1
    return cut(centred(d).withColumn("idx", place).drop("_c"))


DOC_KEYS = ["document_id", "page_number", "table_idx"]
ON_PAGE = DOC_KEYS[:2]
#: A segment as kept() takes it: centre, number, box, score.
SEGMENT = "struct<c:double,o:int,x1:double,y1:double,x2:double,y2:double,score:double>"


def made(d: DataFrame, **columns: Column) -> DataFrame:
    """d with more columns, each made once for a row, however often it is read later."""
    return d.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _box(s: Column) -> tuple[Column, ...]:
    return tuple(s[c] for c in SIDES)


def _clusters(words: Column, t: Column, down: bool) -> Column:
    """What segments_of_words() gives for one table, from the array of its page's words: boxes from the table's corner, as segments."""
    low, high, least, times = ("y1", "y2", 6.0, 1.7) if down else ("x1", "x2", 30.0, 2.5)
    solid = (t["x2"] > t["x1"]) & (t["y2"] > t["y1"])
    centre = lambda w: (w[low] + w[high]) / 2
    of = F.filter(words, lambda w: solid & holds_centre(_box(t), _box(w)))

    def found(ws: Column) -> Column:
        n = F.size(ws)
        gap = F.greatest(F.lit(least), F.element_at(F.sort_array(F.transform(ws, lambda w: w[high] - w[low])), F.floor(n / 2).cast("int") + 1) * times)
        ordered = F.sort_array(F.transform(ws, lambda w: F.struct(centre(w).alias("at"), w["word_idx"].alias("o"), w[low].alias("low"), w[high].alias("high"))))
        return once(F.struct(ordered.alias("w"), gap.alias("gap")), lambda s: cuts(s["w"], s["gap"], n))

    def cuts(ws: Column, gap: Column, n: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ws, i)["at"] - F.get(ws, i - 1)["at"] > gap))
        return once(starts, lambda starts: F.transform(starts, lambda at, j: hull(F.slice(ws, at + 1, F.coalesce(F.get(starts, j + 1), n) - at), j)))

    def hull(ws: Column, j: Column) -> Column:
        a, b = F.array_min(F.transform(ws, lambda w: w["low"])), F.array_max(F.transform(ws, lambda w: w["high"]))
        sides = (t["x1"] - t["x1"], a - t["y1"], t["x2"] - t["x1"], b - t["y1"]) if down else (a - t["x1"], t["y1"] - t["y1"], b - t["x1"], t["y2"] - t["y1"])
        return _segment(j, sides, F.least(F.lit(1.0), 0.5 + F.size(ws) / 20), down)

    return once(of, lambda ws: F.when(F.size(ws) > 0, found(ws)).otherwise(F.array().cast(f"array<{SEGMENT}>")))


def _segment(idx: Column, sides: tuple[Column, ...], score: Column, down: bool) -> Column:
    a, b = (sides[1], sides[3]) if down else (sides[0], sides[2])
    return F.struct(((a + b) / 2).alias("c"), idx.cast("int").alias("o"), *(x.cast("double").alias(c) for x, c in zip(sides, SIDES)), score.cast("double").alias("score"))


def _segments(found: Column, words: Column, t: Column, down: bool) -> Column:
    """What segments() gives for one table, from the arrays of its page's segments and words: an array (c, idx, box, score) by idx, empty for a table whose keys aren't all known."""
    own = F.sort_array(F.transform(F.filter(found, lambda s: s["table_idx"] == t["table_idx"]), lambda s: _segment(s["idx"], _box(s), s["score"], down)))
    own = once(own, lambda b: F.when(F.size(b) > 0, kept(b, SEGMENT)).otherwise(b))
    zero = F.lit(0.0)
    all_ = F.array(_segment(F.lit(0), (zero, zero, t["x2"] - t["x1"], t["y2"] - t["y1"]), zero, down))
    more = lambda b: once(_clusters(words, t, down), lambda i: F.when(F.size(b) < F.least(F.lit(2), F.size(i)), i).otherwise(b))
    some = once(own, lambda b: F.when(F.size(b) < 2, more(b)).otherwise(b))
    some = once(some, lambda b: F.when(F.size(b) > 0, F.sort_array(b)).otherwise(all_))
    known = F.col("document_id").isNotNull() & F.col("page_number").isNotNull() & t["table_idx"].isNotNull()
    numbered = F.transform(some, lambda s, i: F.struct(s["c"].alias("c"), i.alias("idx"), *(s[c].alias(c) for c in SIDES), s["score"].alias("score")))
    return F.when(known, numbered).otherwise(F.filter(numbered, lambda s: F.lit(False)))


def _merged(r: Column, c: Column, spans: Column, at: Column) -> Column:
    """What merged() gives for one table: an array (span_idx, rows, cols), the numbers of what a span meets."""
    met = lambda of, s: F.transform(F.filter(of, lambda x: meets(_box(x), _box(s)) & (overlap(_box(x), _box(s)) >= HIT)), lambda x: x["idx"])
    own = F.filter(spans, lambda s: s["table_idx"] == at)
    return F.filter(F.transform(own, lambda s: F.struct(s["span_idx"].alias("span_idx"), met(r, s).alias("rows"), met(c, s).alias("cols"))), lambda m: (F.size(m["rows"]) > 0) & (F.size(m["cols"]) > 0))


def _text(words: Column, b: tuple[Column, ...], least: float) -> Column:
    """What words_in_cells() gives for one cell; empty if no word lies in it."""
    hit = F.filter(words, lambda w: meets(_box(w), b) & (overlap(_box(w), b) >= least))
    return F.array_join(F.transform(F.sort_array(F.transform(hit, lambda w: F.struct(F.round(w["y1"], 1).alias("y"), w["x1"].alias("x1"), w["word_idx"].alias("o"), w["text"].alias("text")))), lambda w: w["text"]), " ")


def _cells(rows: Column, cols: Column, merged_: Column, words: Column, read: Column, t: Column) -> Column:
    """What cells() and build() give for one table, but for levels: an array of rows, each an array of cells by column, boxes on the page. A row's words are looked up once, a cell's among these."""

    def cell(r: Column, c: Column, own: Column, read_: Column) -> Column:
        first = F.array_min(F.transform(F.filter(merged_, lambda m: (m["rows"][0] == r["idx"]) & (m["cols"][0] == c["idx"])), lambda m: F.struct(m["span_idx"].alias("span_idx"), F.size(m["rows"]).alias("rows"), F.size(m["cols"]).alias("cols"))))
        b = (c["x1"] + t["x1"], r["y1"] + t["y1"], c["x2"] + t["x1"], r["y2"] + t["y1"])
        taken = lambda name, text, other: once(F.trim(text), lambda x: F.when(x != "", F.struct(x.alias("text"), F.lit(name).alias("text_source"))).otherwise(other))
        text = taken("pdf_text", _text(own, b, 0.2), taken("ocr", _text(read_, b, 0.15), F.struct(F.lit("").alias("text"), F.lit("none").alias("text_source"))))
        kind = lambda m: F.when(r["idx"] == 0, "column_header").when(m.isNotNull(), "header").otherwise("data")
        return once(F.struct(first.alias("m"), text.alias("t")), lambda s: F.struct(
            r["idx"].alias("row_idx"), c["idx"].alias("col_idx"), F.coalesce(s["m"]["rows"], F.lit(1)).alias("row_span"), F.coalesce(s["m"]["cols"], F.lit(1)).alias("col_span"), kind(s["m"]).alias("cell_type"),
            F.struct(*(x.alias(n) for x, n in zip(b, ("xmin", "ymin", "xmax", "ymax")))).alias("bbox"), s["t"]["text"].alias("raw_text"), s["t"]["text_source"].alias("text_source"), F.round((r["score"] + c["score"]) / 2, 4).alias("confidence"),
        ))

    def row(r: Column) -> Column:
        level = lambda ws: F.filter(ws, lambda w: (F.trim(w["text"]) != "") & (w["y1"] < r["y2"] + t["y1"]) & (w["y2"] > r["y1"] + t["y1"]))
        behind = lambda m, c: F.array_contains(m["rows"], r["idx"]) & F.array_contains(m["cols"], c["idx"]) & ~((m["rows"][0] == r["idx"]) & (m["cols"][0] == c["idx"]))
        there = F.filter(cols, lambda c: (c["x2"] > c["x1"]) & (r["y2"] > r["y1"]) & ~F.exists(merged_, lambda m: behind(m, c)))
        return once(F.struct(level(words).alias("w"), level(read).alias("r")), lambda s: F.transform(there, lambda c: cell(r, c, s["w"], s["r"])))

    return F.filter(F.transform(rows, row), lambda cs: F.size(cs) > 0)


def _levelled(rows: Column, table_id: Column) -> Column:
    """The cells as documents have them, an array for each row: with ids, and the levels that cell_levels() adds."""

    def of(c: Column, first: Column) -> Column:
        low, some = c["row_idx"] > 0, c["raw_text"] != ""
        own = low & some & (c["col_idx"] == first["col_idx"]) & ((c["cell_type"] == "header") | (first["col_idx"] > 0) | c["raw_text"].rlike(ENUMERATED))
        found = F.when(low & (c["row_span"] > 1) & some, 1).when(own, level(first["raw_text"], first["col_idx"], first["col_span"]))
        kept_ = lambda *names: [c[n].alias(n) for n in names]
        cell = F.concat(table_id, F.lit("_r"), c["row_idx"].cast("string"), F.lit("_c"), c["col_idx"].cast("string"))
        return F.struct(
            cell.alias("cell_id"), *kept_("row_idx", "col_idx", "row_span", "col_span", "cell_type"), found.cast("int").alias("hierarchy_level"), *kept_("bbox", "raw_text", "text_source"), F.lit(None).cast("string").alias("image_b64"), *kept_("confidence")
        )

    return F.transform(rows, lambda cs: once(F.get(F.filter(cs, lambda c: c["raw_text"] != ""), F.lit(0)), lambda first: F.transform(cs, lambda c: of(c, first))))


def _judged(rows: Column, t: Column) -> Column:
    """What checked() says of one table: (checks, warnings)."""

    def row(cs: Column) -> Column:
        out = lambda b: ~((t["x2"] > b["xmin"]) & (b["xmax"] > t["x1"]) & (t["y2"] > b["ymin"]) & (b["ymax"] > t["y1"]))
        numbers = F.filter(F.transform(F.filter(cs, lambda c: c["raw_text"] != ""), lambda c: F.struct(*(x.alias(n) for x, n in zip(numeric_cell(c["raw_text"]), ("number", "percent"))))), lambda n: n["number"].isNotNull())
        any_ = lambda test: F.exists(cs, test)
        return once(numbers, lambda ns: once(F.struct(F.transform(F.filter(ns, lambda n: ~n["percent"]), lambda n: n["number"]).alias("plain"), F.try_element_at(F.filter(ns, lambda n: n["percent"]), F.lit(-1))["number"].alias("stated")), lambda n: F.struct(
            any_(lambda c: c["raw_text"] != "").alias("filled"), any_(lambda c: c["text_source"] == "pdf_text").alias("native"), any_(lambda c: c["text_source"] == "ocr").alias("ocr"), any_(lambda c: (c["row_span"] > 1) | (c["col_span"] > 1)).alias("merged"),
            any_(lambda c: c["hierarchy_level"].isNotNull()).alias("levels"), F.size(F.filter(cs, lambda c: out(c["bbox"]))).cast("long").alias("outside"), row_ratio(cs[0]["row_idx"], n["plain"], n["stated"]).alias("r"),
        )))

    def table(rs: Column) -> Column:
        any_ = lambda name: F.exists(rs, lambda r: r[name]).alias(name)
        some = map(any_, ("filled", "native", "ocr", "merged", "levels"))
        first = F.get(F.filter(F.transform(rs, lambda r: r["r"]), lambda r: r.isNotNull()), F.lit(0))
        return F.struct(*some, F.aggregate(rs, F.lit(0).cast("long"), lambda n, r: n + r["outside"]).alias("outside"), first.alias("r"))

    def verdict(s: Column) -> Column:
        checks, warnings = said(*(s[c] for c in ("filled", "native", "ocr", "merged", "levels", "outside", "r")))
        return F.struct(checks.alias("checks"), warnings.alias("warnings"))

    bare = F.struct(F.array(*map(F.lit, BARE_CHECKS)).alias("checks"), F.array(*map(F.lit, BARE_WARNINGS)).alias("warnings"))
    return F.when(F.size(rows) > 0, once(F.transform(rows, row), lambda rs: once(table(rs), verdict))).otherwise(bare)


def document_tables(tables: DataFrame, rows: DataFrame, columns: DataFrame, spans: DataFrame, words: DataFrame, read: DataFrame) -> DataFrame:
    """The tables of hand-off documents, from detections in one call: a row (the table's keys, t) for each, with its cells by row and column, links to the pages before and behind, checks.

    tables: document_id, page_number, table_idx, label, score, box; rows, columns, spans (span_idx): the table's keys, idx,
    box from its corner, score; words, read: document_id, page_number, word_idx, text, box. Documents never mix, whatever
    pages and tables they have. What was found on a page is one row, dealt by document and page once, and inputs that are
    dealt so already don't move; cells are made in that row and neither moved nor written. Of a table, only what its links
    need (the parts of its columns) goes to the pages before and behind.
    """
    sides = [F.col(c).cast("double").alias(c) for c in SIDES]
    listed = lambda d, name, *fields: d.groupBy(*ON_PAGE).agg(F.collect_list(F.struct(*fields, *sides)).alias(name))
    score, idx = F.col("score").cast("double").alias("score"), F.col("idx").cast("int").alias("idx")
    told = lambda d: d.where(F.coalesce("text", F.lit("")) != "")
    page = tables.groupBy(*ON_PAGE).agg(F.collect_list(F.struct("table_idx", F.coalesce("label", F.lit("table")).alias("label"), score, *sides)).alias("tables"))
    for name, d in (("rows", listed(rows, "rows", "table_idx", idx, score)), ("cols", listed(columns, "cols", "table_idx", idx, score)), ("spans", listed(spans, "spans", "table_idx", "span_idx")), ("words", listed(told(words), "words", "word_idx", "text")), ("read", listed(told(read), "read", "word_idx", "text"))):
        page = page.join(d, ON_PAGE, "left").withColumn(name, F.coalesce(name, F.array().cast(d.schema[name].dataType)))

    parts = lambda c: profile(F.transform(c, lambda x: x["x1"]), F.transform(c, lambda x: x["x2"]))
    own = F.transform("tables", lambda t: F.struct(t["table_idx"].alias("idx"), once(_segments(F.col("cols"), F.col("words"), t, False), parts).alias("profile"), (t["x2"] - t["x1"]).alias("width"), t["x1"].alias("x")))
    places = F.array(*(F.struct((F.col("page_number") + k).alias("page_number"), F.lit(k).alias("k"), F.col("own").alias("own")) for k in (-1, 0, 1)))
    sent = made(page.select(*ON_PAGE, "tables", "cols", "words"), own=own).select("document_id", F.inline(places))
    none = F.array().cast(sent.schema["own"].dataType)
    of = lambda k, name: F.flatten(F.collect_list(F.when(F.col("k") == k, F.col("own")))).alias(name)
    met = sent.groupBy(*ON_PAGE).agg(of(0, "own"), of(1, "before"), of(-1, "behind")).where(F.size("own") > 0)
    links = met.select(*ON_PAGE, page_links(*(F.coalesce(c, none) for c in ("own", "before", "behind"))).alias("links"))

    d = page.join(links, ON_PAGE, "left").select("*", F.inline("tables")).drop("tables")
    t = {c: F.col(c) for c in ("table_idx", *SIDES)}
    found = lambda name, down: _segments(F.col(name), F.col("words"), t, down)
    d = made(d, r=found("rows", True), c=found("cols", False)).drop("rows", "cols")
    d = made(d, m=_merged(F.col("r"), F.col("c"), F.col("spans"), t["table_idx"]), table_id=cell_id(F.col("page_number"), t["table_idx"])).drop("spans")
    d = d.select("*", F.inline_outer(F.filter("links", lambda x: x["idx"] == t["table_idx"]))).drop("links")
    d = made(d, by_row=_cells(F.col("r"), F.col("c"), F.col("m"), F.col("words"), F.col("read"), t)).withColumns({"n_rows": F.size("r"), "n_cols": F.size("c")}).drop("r", "c", "m", "words", "read")
    d = made(d, cells=_levelled(F.col("by_row"), F.col("table_id"))).drop("by_row")
    d = made(d.select("*", F.inline(F.array(_judged(F.col("cells"), t)))), all_cells=F.flatten("cells")).drop("cells")

    page, before, behind = F.col("page_number"), F.col("continues_from"), F.col("linked")
    own_id = lambda page, idx: F.when(idx.isNotNull(), cell_id(page, idx))
    linked = F.struct(
        before.isNotNull().alias("is_continuation"), own_id(page - 1, before).alias("continues_from"), behind.isNotNull().alias("continues_on_next_page"), own_id(page + 1, behind).alias("linked_table_id"), "match_score",
    )
    table = F.struct(
        "table_id", "page_number", F.struct(*(t[a].alias(b) for a, b in zip(SIDES, ("xmin", "ymin", "xmax", "ymax")))).alias("bbox"), F.col("score").alias("confidence"), "label",
        F.struct(F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols")).alias("grid"), linked.alias("continuation"), F.col("all_cells").alias("cells"),
        F.struct((F.size("warnings") == 0).alias("is_valid"), F.col("checks").alias("checks_performed"), "warnings").alias("validation"),
    )
    return d.select(*DOC_KEYS, table.alias("t"))


def documents(docs: DataFrame, tables: DataFrame, rows: DataFrame, columns: DataFrame, spans: DataFrame, words: DataFrame, read: DataFrame) -> DataFrame:
    """Hand-off documents, as files.handoffs() reads them: the tables of document_tables() in the order of pages, one array for each document; one without tables has an empty array.

    docs: document_id, source_file, page_count, processed_at, model_version. A document is one row, so this is for documents
    as files hold them; where pages have no bound, document_tables() has the same tables as rows.
    """
    each = document_tables(tables, rows, columns, spans, words, read)
    each = each.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "table_idx", "t"))), lambda x: x["t"]).alias("tables"))
    d = docs.join(each, "document_id", "left")
    return d.select("document_id", "source_file", "page_count", "processed_at", "model_version", F.coalesce("tables", F.array().cast(each.schema["tables"].dataType)).alias("tables"))


def in_page_order(pages: DataFrame, page: str = "page_number", tables: str = "tables") -> DataFrame:
    """One row: the tables of all pages of a document in the order of pages. pages: document_id, page, tables."""
    each = F.sort_array(F.collect_list(F.struct(page, F.col(tables).alias("t"))))
    return pages.groupBy("document_id").agg(F.flatten(F.transform(each, lambda x: x["t"])).alias(tables))


def word_hull(words: DataFrame, keys: list[str], margin: int = 12) -> DataFrame:
    """The box around the words of each key with a margin, not below 0."""
    low = lambda c: F.greatest(F.min(c) - margin, F.lit(0)).alias(c)
    return words.groupBy(*keys).agg(low("x1"), low("y1"), (F.max("x2") + margin).alias("x2"), (F.max("y2") + margin).alias("y2"))


def with_errors(found: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Cells with errors of one kind put in by rule: missing (every fourth by a hash), moved (boxes up to 10 units by a hash), text (every other marked), merged (every fifth but the last over two rows), uncertain (confidence 0.5); none leaves them."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("cell_idx")) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    d = found.withColumn("_at", at).withColumn("_n", n)
    if kind == "missing":
        order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("cell_idx"), "cell_idx"))
        d = d.withColumn("_k", order).where(F.col("_k") > F.greatest(F.floor(F.col("_n") / 4), F.lit(1))).drop("_k")
    elif kind == "moved":
        for k, c in enumerate(("x1", "y1", "x2", "y2")):
            d = d.withColumn(c, F.col(c) + F.pmod(F.xxhash64("cell_idx", F.lit(k)), F.lit(2001)) / 100 - 10)
    elif kind == "text":
        d = d.withColumn("text", F.when(F.col("_at") % 2 == 0, F.concat(F.lit("CORRUPTED_"), "text")).otherwise(F.col("text")))
    elif kind == "merged":
        d = d.withColumn("row_span", F.when((F.col("_at") % 5 == 0) & (F.col("_at") < F.col("_n") - 1), 2).otherwise(F.col("row_span")))
    elif kind == "uncertain":
        d = d.withColumn("confidence", F.lit(0.5))
    elif kind != "none":
        raise ValueError("kind is one of missing, moved, text, merged, uncertain, none")
    return d.drop("_at", "_n")
