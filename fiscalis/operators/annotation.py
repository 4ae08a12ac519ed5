"""Annotation tasks: export rows to boxes, splits, the next pages to label, and whether the targets are met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.functions.geometry import centred, of_percent
from fiscalis.functions.text import base_name

#: Labels of each stage; pages, boxes and split that are aimed at.
LABELS = {
    "detection": ("table", "table_rotated"),
    "structure": ("table_row", "table_column", "table_spanning_cell", "table_projected_row_header", "table_column_header"),
}
PAGES, FEWEST_BOXES, MOST_BOXES = 100, 150, 200
SPLIT = {"train": 0.70, "val": 0.15, "test": 0.15}
TOLERANCE = 0.03


def boxes(results: DataFrame, stage: str = "detection") -> DataFrame:
    """Rectangles of an export as boxes in pixels: file, label, xmin to ymax. results: image, type, label, x, y, width, height (percentages), original_width, original_height."""
    if stage not in LABELS:
        raise ValueError(f"stage is one of {sorted(LABELS)}")
    d = results.where((F.col("type") == "rectanglelabels") & F.col("label").isin(*LABELS[stage]))
    b = of_percent(*(F.coalesce(c, F.lit(0.0)) for c in ("x", "y", "width", "height")), F.col("original_width"), F.col("original_height"))
    return d.select(base_name(F.col("image")).alias("filename"), F.col("label").alias("name"), F.col("original_width").alias("image_width"), F.col("original_height").alias("image_height"), *(c.alias(n) for c, n in zip(b, ("xmin", "ymin", "xmax", "ymax"))))


def training_boxes(found: DataFrame) -> DataFrame:
    """Boxes of annotation files as a trainer takes them: per file its size, and centre, width and height of each box as parts of it, with labels in the same order; files without a box have empty arrays. found: filename, width, height, name, xmin to ymax."""
    b = centred(tuple(F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")), F.col("width"), F.col("height"))
    one = F.when(F.col("name").isNotNull(), F.struct("name", F.array(*b).alias("box")))
    d = found.groupBy("filename").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.sort_array(F.collect_list(one)).alias("b"))
    return d.select("filename", F.array("height", "width").alias("orig_size"), F.transform("b", lambda x: x["box"]).alias("boxes"), F.transform("b", lambda x: x["name"]).alias("labels"))


def page_of(stem: Column) -> tuple[Column, Column]:
    """The report and the page that a page image's name states: what stands before the last _page_, and the number behind it (0 if none)."""
    report = F.when(stem.contains("_page_"), F.regexp_extract(stem, "^(.*)_page_", 1)).otherwise(stem)
    return report, F.coalesce(F.nullif(F.regexp_extract(stem, r"_page_(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def page_name(stem: Column, page: Column) -> Column:
    return F.concat(stem, F.lit("_page_"), F.when(page < 1000, F.lpad(page.cast("string"), 3, "0")).otherwise(page.cast("string")))


def pages_between(pages: DataFrame, page: str, first: int | None = None, last: int | None = None, most: int | None = None) -> DataFrame:
    """Pages of a range, counted from 1 with both ends, or the first `most` of them; what isn't given doesn't limit."""
    for low, high in ((first or 1, last), (1, most)):
        pages = pages.where((F.col(page) >= low) & (F.lit(True) if high is None else F.col(page) <= high))
    return pages


def split_parts(items: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds part: 70 % train, 15 % val, both rounded down, the rest test, in an order by hash of the key.

    Places are counted per range of the hash by its task, and the ranges' sizes are added up, so no task sees all rows.
    """
    ordered = items.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    ranges = F.shiftright(F.col("_h"), 48)  # 65,536 of them, whatever the input
    sizes = ordered.groupBy(ranges.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    sizes = sizes.select("_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    d = ordered.withColumn("_range", ranges).join(F.broadcast(sizes), "_range")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    train, val = F.floor(F.col("_all") * SPLIT["train"]), F.floor(F.col("_all") * SPLIT["val"])
    part = F.when(F.col("_place") < train, "train").when(F.col("_place") < train + val, "val").otherwise("test")
    return d.withColumn("_place", place).withColumn("part", part).drop("_h", "_range", "_before", "_all", "_place")


def next_tasks(pages: DataFrame, used: DataFrame, group: str, key: str, most: int = 10, fewest_tables: int = 1, least_score: float = 0.0, scored: bool = False) -> DataFrame:
    """The first pages of each report, in the order of the key, that were not used before; with scored only those of enough tables and score. Used ones don't count towards the number."""
    d = pages.join(used.select(key).distinct(), key, "left_anti")
    if scored:
        d = d.where((F.col("n_tables") >= fewest_tables) & (F.col("model_score") >= least_score))
    return d.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_k") <= most).drop("_k")


def of_split(items: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The items whose key the split file lists."""
    return items.join(listed.select(key).distinct(), key, "left_semi")


def compliance(tasks: DataFrame, boxes_: DataFrame, splits: DataFrame) -> DataFrame:
    """One row: tasks, tasks with boxes, boxes, sizes of the splits, and whether pages, boxes and split meet the targets. tasks: has_boxes; splits: part."""
    n = splits.agg(*(F.count_if(F.col("part") == p).alias(p) for p in SPLIT))
    d = tasks.agg(F.count("*").alias("tasks"), F.count_if("has_boxes").alias("tasks_with_boxes")).join(boxes_.agg(F.count("*").alias("boxes"))).join(n)  # one row each
    total = sum((F.col(p) for p in SPLIT), F.lit(0))
    fits = F.lit(True)
    for part, share in SPLIT.items():
        fits = fits & (F.abs(F.coalesce(F.col(part) / F.nullif(total, F.lit(0)), F.lit(0.0)) - share) <= TOLERANCE)
    d = d.withColumn("pages_ok", F.col("tasks") >= PAGES).withColumn("boxes_ok", F.col("boxes").between(FEWEST_BOXES, MOST_BOXES)).withColumn("split_ok", fits)
    return d.withColumn("compliant", F.col("pages_ok") & F.col("boxes_ok") & F.col("split_ok"))


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many different keys two splits share."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared"))


#: Characters of the grams by which names are looked up.
GRAM = 3


def _grams(name: Column, all_sizes: bool) -> Column:
    """The different grams of a name: those of GRAM characters, and with all_sizes the shorter ones as well; of a name that is shorter, the name."""
    of = lambda k: F.when(F.length(name) >= k, F.transform(F.sequence(F.lit(1), F.length(name) - (k - 1)), lambda i: F.substring(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    if all_sizes:
        return F.array_distinct(F.flatten(F.array(*map(of, range(1, GRAM + 1)))))
    return F.when(F.length(name) < GRAM, F.filter(F.array(name), lambda x: x != "")).otherwise(F.array_distinct(of(GRAM)))


def held_in(inner: DataFrame, outer: DataFrame, inner_col: str, outer_col: str, key: str = "folder") -> DataFrame:
    """(key, inner, outer) of the different texts of one key of which the first is held in the second; empty texts are held in none.

    A text that holds another holds all of its grams, so each inner text is looked up by one, that which fewest outer texts
    of the key have, and compared with those texts alone.
    """
    a = inner.select(key, F.col(inner_col).alias("_in")).where("_in <> ''").distinct()
    b = outer.select(key, F.col(outer_col).alias("_out")).where("_out <> ''").distinct()
    index = b.select(F.col(key).alias("_key"), "_out", F.explode(_grams(F.col("_out"), True)).alias("_gram"))
    often = index.groupBy("_key", "_gram").agg(F.count("*").alias("_n"))
    asked = a.select(key, "_in", F.explode(_grams(F.col("_in"), False)).alias("g"))
    # a gram that no outer text has rules the inner one out: it is the rarest
    rare = asked.join(often, (F.col(key) == F.col("_key")) & (F.col("g") == F.col("_gram")), "left").groupBy(key, "_in").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0")
    near = rare.join(index, (F.col(key) == F.col("_key")) & (F.col("m.g") == F.col("_gram")))
    return near.where(F.contains("_out", "_in")).select(key, F.col("_in").alias("inner"), F.col("_out").alias("outer"))


def same_name(a: DataFrame, b: DataFrame, left: str = "name", right: str = "file") -> DataFrame:
    """Each name of a with a file of b of its folder (column folder on both sides): the equal one, else the first, by name, that holds it or is held by it. An empty name takes the folder's first file, an empty file is held by every name; null names and folders have none."""
    names, files_ = a.select("folder", F.col(left).alias("name")).distinct(), b.select("folder", F.col(right).alias("file")).distinct()
    up = held_in(names, files_, "name", "file").select("folder", F.col("inner").alias("name"), F.col("outer").alias("file"))
    down = held_in(files_, names, "file", "name").select("folder", F.col("outer").alias("name"), F.col("inner").alias("file"))
    first = files_.groupBy("folder").agg(F.min("file").alias("file"))
    blank = names.where("name = ''").join(first, "folder").unionByName(names.where("name is not null").join(files_.where("file = ''"), "folder"))
    best = F.min(F.struct((F.col("name") != F.col("file")).alias("unlike"), "file")).alias("b")
    return up.unionByName(down).unionByName(blank).groupBy("folder", "name").agg(best).select("folder", F.col("name").alias(left), F.col("b.file").alias("file"))
