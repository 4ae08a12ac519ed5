"""Benchmark decontamination: short test items inside long documents, by MinHash containment search partitioned by size.

All by DataFrame functions. Items are put into partitions by their number of shingles (powers of two), and each keeps its
smallest shingle hashes, those that few items have first, as a MinHash sketch whose length the partition sets. The part
of the sketch that a document has estimates the item's containment in it, and does so for short items in long documents,
since the document's side is all its shingles, not a sample of them.

If the containment is at least t, the document lacks at most q - ceil(t * q) of the item's q shingles, so of a sketch of
k hashes it has at least k less that number. Sketches are MORE longer than it, hence pairs of document and item with
enough hashes miss none and are few. For these pairs the shingles themselves, not hashes, are compared and counted.

A document's shingles leave it only as far as the join with the sketches; these are broadcast while their counted number
is small (they grow with the benchmark, not with the documents), else both sides are shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import broadcast_if, materialize, pick, table, text_of
from fiscalis.sources.tables import spread

WIDTH = 5
CONTAINMENT = 0.8
#: Hashes that a document with an item must share with its sketch, where the item has so many.
MORE = 4
#: Rows of sketches (40 bytes each) and bytes of items' shingles that are broadcast at most.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: What separates words here: anything but letters and digits, so that case and punctuation don't hide a passage.
APART = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits; one empty word if there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), APART, " ")), " ")


def _hashed(d: DataFrame, widths: list[int]) -> DataFrame:
    """(id, sub, hash) of each shingle of each width. Words are laid beside those that follow by shifted copies of the array, so rows and hashes are made in generated code."""
    columns = [f"w{k}" for k in range(max(widths))]
    w = F.col("w")
    shifted = [w.alias("w0"), *(F.slice(w, F.lit(k + 1), F.size(w)).alias(c) for k, c in enumerate(columns) if k)]
    rows = d.select("id", "sub", F.inline(F.arrays_zip(*shifted))).toDF("id", "sub", *columns)
    if len(widths) == 1:
        return rows.where(F.col(columns[-1]).isNotNull()).select("id", "sub", F.xxhash64(*columns).alias("hash"))
    each = F.array(*(F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*columns[:k])) for k in widths))
    return rows.select("id", "sub", F.explode(each).alias("hash")).where("hash is not null")


def _texts(width: int) -> Column:
    at = F.sequence(F.lit(1), F.size("w") - width + 1)
    shingle = F.transform(at, lambda i: F.array_join(F.slice("w", i, width), " "))
    return F.when(F.size("w") >= width, F.array_distinct(shingle)).otherwise(F.array().cast("array<string>"))


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item, shingle, hash, q, width): the distinct shingles of each item, q their number; an item of fewer words is one shingle of all its words."""
    w = items.select("item", words(text_of("text")).alias("w")).where(F.get("w", F.lit(0)) != "").select("item", "w", F.least(F.size("w"), F.lit(width)).alias("width"))
    shingle = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))
    each = w.select("item", "width", F.explode(F.array_distinct(shingle)).alias("s")).distinct()
    q = each.groupBy(F.col("item").alias("of")).agg(F.count_distinct("s").alias("q"))
    hashed = F.lit(0).cast("long")
    for k in range(1, width + 1):
        hashed = F.when(F.col("width") == k, F.xxhash64(*(F.get("s", F.lit(i)) for i in range(k)))).otherwise(hashed)
    return each.join(q, F.col("item").eqNullSafe(F.col("of"))).select("item", "width", F.array_join("s", " ").alias("shingle"), hashed.alias("hash"), "q")


def sketches(shingles: DataFrame, containment: float) -> DataFrame:
    """(item, hash, width, size, least): the sketch of each item, its size, and how many of its hashes a document that contains the item has at least."""
    lacking = lambda n: F.col(n) - F.ceil(F.col(n) * containment - 1e-9)
    rare = shingles.groupBy(F.col("hash").alias("of")).agg(F.floor(F.log2(F.count("*"))).alias("common"))
    d = shingles.join(rare, F.col("hash") == F.col("of")).withColumn("size_class", F.floor(F.log2("q")))
    largest = d.groupBy("size_class").agg(F.max("q").alias("u"))
    of_item = d.groupBy("item", "size_class", "q").agg(F.sort_array(F.collect_list(F.struct("common", "hash", "width"))).alias("all"))
    size = F.least("q", lacking("u") + MORE).cast("int")
    cut = of_item.join(largest, "size_class").withColumn("size", size).select("item", "size", (F.col("size") - lacking("q")).alias("least"), F.explode(F.slice("all", F.lit(1), F.col("size"))).alias("x"))
    return cut.select("item", "x.hash", "x.width", "size", "least").distinct()


def candidates(hashes: DataFrame, sketch: DataFrame, rows: int) -> DataFrame:
    """(id, sub, item, estimate) of the documents with enough of an item's sketch; the estimate of the containment is the part of the sketch that is there."""
    hits = hashes.join(broadcast_if(sketch.select("hash", "item", "size", "least"), rows, BROADCAST_ROWS), "hash")
    counted = hits.groupBy("id", "sub", "item", "size", "least").agg(F.count_distinct("hash").alias("n")).where("n >= least")
    return counted.select("id", "sub", "item", (F.col("n") / F.col("size")).alias("estimate"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row (id, item, containment, n_shingles, n_found) for each document and item with at least that part of the item's distinct word shingles in the document.

    Items of fewer than `width` words are one shingle; items without a word (null texts too) are in no document. Documents
    without words contain nothing. Repeated rows give one result; rows that share an id but not the text are taken one by
    one, and the largest containment is given. Items that share an id count as one item with the shingles of all its rows.
    Null ids of documents or items are kept as ids. Empty tables give an empty result. more: as for contained_by_text.
    """
    best = contained_by_text(docs, items, id_col, text_col, **more).groupBy("id", "item").agg(F.max("n_found").alias("n_found"), F.max("n_shingles").alias("n_shingles"))
    return best.select("id", "item", (F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found")


def contained_by_text(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    containment: float = CONTAINMENT, width: int = WIDTH,
) -> DataFrame:
    """The same before texts that share an id are put together: (id, sub, item, n_shingles, n_found), sub a hash of the text."""
    shingles = materialize(item_shingles(pick(items, item=item_col, text=item_text_col), width), "items")
    sketch = materialize(sketches(shingles, containment), "sketches")
    widths = sorted(r[0] for r in sketch.select("width").distinct().collect())  # at most `width` values
    d = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    if not widths:
        return d.select("id").where(F.lit(False)).selectExpr("id", "cast(null as bigint) sub", "cast(null as bigint) item", "cast(null as bigint) n_shingles", "cast(null as bigint) n_found")

    d = d.withColumn("sub", F.xxhash64("text"))
    each = _hashed(d.select("id", "sub", words(F.col("text")).alias("w")), widths)
    pairs = materialize(candidates(each, sketch, sketch.count()), "candidates")

    # the candidates grow with the documents: both sides are shuffled by document at any size
    of_pair = pairs.select(F.col("id").alias("i"), F.col("sub").alias("s"), F.col("item").alias("of"))
    one = F.col("id").eqNullSafe(F.col("i")) & (F.col("sub") == F.col("s"))
    found = d.join(of_pair.select("i", "s").distinct().hint("merge"), one, "left_semi").dropDuplicates(["id", "sub"]).select("id", "sub", words(F.col("text")).alias("w"))
    own = found.select("id", "sub", F.explode(F.array_distinct(F.flatten(F.array(*(_texts(k) for k in widths))))).alias("own"))
    n_bytes = shingles.agg(F.coalesce(F.sum(F.octet_length("shingle") + 64), F.lit(0))).first()[0]
    want = of_pair.join(broadcast_if(shingles.select("item", "shingle", "q"), n_bytes, BROADCAST_BYTES), F.col("of").eqNullSafe(F.col("item"))).select("i", "s", "item", "q", "shingle")
    counted = own.join(want, one & (F.col("own") == F.col("shingle"))).groupBy("id", "sub", "item", "q").agg(F.count("*").alias("n_found")).where(F.col("n_found") >= F.col("q") * containment - 1e-9)
    return counted.select("id", "sub", "item", F.col("q").alias("n_shingles"), "n_found")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs without an item in their text. Each row is judged by its own text: other rows with its id, null ones included, stay or go by theirs."""
    leaked = contained_by_text(docs, items, id_col, text_col, **more).select(F.col("id").alias("__leaked_id"), F.col("sub").alias("__leaked_sub")).distinct()
    own_id, own_sub = docs[f"`{id_col}`"].cast("long"), F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    return docs.join(leaked.hint("merge"), own_id.eqNullSafe(F.col("__leaked_id")) & (own_sub == F.col("__leaked_sub")), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    found = contained(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def oracle() -> str:
    """The query in DuckDB's SQL, without sketches."""
    words_ = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
    WITH b AS (SELECT item_id, {words_} AS w FROM benchmark),
    bs AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS k, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS s
        FROM b, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS u(i) WHERE len(w) > 0),
    q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id),
    d AS (SELECT doc_id, {words_} AS w FROM documents),
    ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM bs) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
    n AS (SELECT doc_id, item_id, count(*) AS n FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
    SELECT doc_id, n.item_id, n / q AS containment, q AS n_shingles, n AS n_found FROM n JOIN q ON n.item_id IS NOT DISTINCT FROM q.item_id WHERE n >= q * {CONTAINMENT} - 1e-9"""
