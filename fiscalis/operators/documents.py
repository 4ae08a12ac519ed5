"""Report text: chunks, lines, sections, page features, project rows, entities, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.operators.annotation import held_in

WINDOW, STRIDE = 512, 461
NATIVE = 150
#: What counts as a number of a financial table, and the words of one.
NUMBER = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+\.\d+\b|\b\d+%\b"
KEYWORDS = "budget|actual|variance|total|expenditure|revenue|county|ksh|audit|statement|summary|amount|approved|collection"
SPLIT_THOUSANDS = r"(?<=\d),\s+(?=\d)"
AMOUNT = r"[\d,]{5,}(?:\.\d+)?"
#: What stands for a number, and what is cut off a line's ends.
MARK, BLANKS = "\x01", " \t\x0b\f\r"
HEADER = r"(?i)^(Sector|Project|Location|Contract|Amount|No\.|S/N|Budget)"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Overlapping windows of words: ceil(n / stride) of them, none for an empty text."""
    d = docs.select(F.col(id_col), tokens(F.coalesce(text_col, F.lit(""))).alias("w")).where(F.size("w") > 0)
    at = d.select(id_col, "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(stride))).alias("chunk_no", "start"))
    part = F.slice("w", F.col("start") + 1, F.lit(window))
    return at.select(id_col, "chunk_no", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longer_than: int = 10) -> DataFrame:
    d = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    return d.select(id_col, "line_no", F.trim("line").alias("line")).where(F.length("line") > longer_than)


def page_features(pages: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Counts per page and their weighted score: 1.2 numbers, 0.8 keywords, 5 lines of three or more numbers, 0.2 lines over 80 characters."""
    text = F.coalesce(text_col, F.lit(""))
    marks = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(MARK), F.lit("")))
    # the whole text is searched once and each number, none of which goes over a line's end, becomes a mark
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), NUMBER, MARK)
    sizes = F.filter(F.transform(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS)))), lambda n: n > 0)
    d = pages.select(*id_cols, marked.alias("m"), sizes.alias("l"), F.regexp_count(text, F.lit(f"(?i){KEYWORDS}")).alias("keyword_hits"))
    d = d.select(
        *id_cols, F.size("l").alias("line_count"), marks(F.col("m")).alias("num_hits"), "keyword_hits", F.size(F.filter(F.split("m", "\n"), lambda x: marks(x) >= 3)).alias("dense_lines"),
        F.size(F.filter("l", lambda n: n > 80)).alias("long_lines"),
    )
    return d.withColumn("score", F.round(1.2 * F.col("num_hits") + 0.8 * F.col("keyword_hits") + 5 * F.col("dense_lines") + 0.2 * F.col("long_lines"), 3))


def top_pages(scored: DataFrame, group: str, key: str, most: int, score: str = "score") -> DataFrame:
    """The best pages of each group with their rank; equals go by key."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def cascade(pages: DataFrame, group: str, key: str, few: int = 40, most: int = 18) -> DataFrame:
    """The pages to label: all of a file of few pages, else its best by text score; of these the best by model score, and then those with a table. pages: group, key, score, model_score, n_tables."""
    n = F.count("*").over(Window.partitionBy(group))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    candidates = pages.withColumn("_n", n).withColumn("_first", first).where((F.col("_n") <= few) | (F.col("_first") <= few)).drop("_n", "_first")
    return top_pages(candidates, group, key, most, "model_score").where("n_tables > 0")


def project_row(line: Column) -> Column:
    """The project that a line of a table states, as a struct; null for headers and for lines of fewer than two amounts."""
    joined = F.regexp_replace(F.trim(line), SPLIT_THOUSANDS, ",")
    percent = F.nullif(F.regexp_extract(joined, r"(\d{1,3}(?:\.\d+)?)\s*$", 1), F.lit("")).try_cast("double")
    found = F.struct(joined.alias("joined"), F.regexp_extract_all(joined, F.lit(AMOUNT), F.lit(0)).alias("amounts"), percent.alias("percent"))
    return F.get(F.transform(F.array(found), lambda s: _stated(F.trim(line), s["joined"], s["amounts"], s["percent"])), F.lit(0))  # found is made once


def _stated(line: Column, joined: Column, amounts: Column, percent: Column) -> Column:
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")
    percent = F.when(percent <= 250, percent)
    status = F.when(F.coalesce(percent, F.lit(0.0)) == 0, "UNKNOWN").when(percent < 30, "LOW").otherwise("NORMAL")
    row = F.struct(
        F.substring(F.trim(F.regexp_replace(joined, AMOUNT, "")), 1, 150).alias("name"), number(F.get(amounts, F.lit(0))).alias("contract_sum"),
        number(F.element_at(amounts, -1)).alias("amount_paid"), percent.alias("implementation_pct"), status.alias("absorption"),
    )
    return F.when(~line.rlike(HEADER) & (F.size(amounts) >= 2), row)


def native_text(pages: DataFrame, placeholder: str, text_col: str = "text") -> DataFrame:
    """Adds the page's own text if it has over 150 characters, else a placeholder, and says which."""
    native = F.length(F.trim(F.coalesce(text_col, F.lit("")))) > NATIVE
    return pages.withColumn("is_native", native).withColumn("page_text", F.when(native, F.trim(text_col)).otherwise(F.lit(placeholder)))


def findings(entities: DataFrame, keys: list[str], shortest: int = 40) -> DataFrame:
    """One finding per sentence of 40 characters or more with a project or a risk: the last project, the amounts in order, and the kind. entities: keys, sentence, ent_idx, entity_group, word."""
    word = F.trim("word")
    amount = F.nullif(F.regexp_replace(word, r"[^\d.]", ""), F.lit("")).try_cast("double")
    project = F.col("entity_group") == "PROJECT_NAME"
    found = entities.where(F.length("sentence") >= shortest).groupBy(*keys).agg(
        F.max_by(F.when(project, word), F.when(project, F.col("ent_idx"))).alias("project_name"),
        F.sort_array(F.collect_list(F.when(F.col("entity_group") == "KSH_AMOUNT", F.struct("ent_idx", amount.alias("amount"))))).alias("a"),
        F.bool_or(F.col("entity_group") == "RISK_FINDING").alias("risk"), F.trim(F.max("sentence")).alias("sentence"),
    )
    amounts = F.filter(F.transform("a", lambda x: x["amount"]), lambda x: x.isNotNull())
    return found.where("project_name is not null or risk").select(
        *keys, "project_name", amounts.alias("amounts"), F.when(F.col("risk"), "FLAGGED_BY_MODEL").otherwise("GENERAL_FINDING").alias("kind"), "sentence"
    )


def triage(pages: DataFrame, key: str, page: str = "page", text_col: str = "text", first: int = 3) -> DataFrame:
    """Whether each file is digital: one of its first pages (counted from 1) has text."""
    has = F.length(F.trim(F.coalesce(text_col, F.lit("")))) > 0
    return pages.groupBy(key).agg(F.coalesce(F.bool_or(has & (F.col(page) <= first)), F.lit(False)).alias("is_digital"))


def report_text(pages: DataFrame, key: str, page: str = "page", text_col: str = "text") -> DataFrame:
    """One text per file: its pages in order, each under a heading with its number."""
    from fiscalis.functions.text import page_heading

    each = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text_col, F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(each, lambda x: page_heading(x["p"], x["t"])), "\n\n").alias("text"))


def _runs(w: Column, k: int) -> Column:
    """Where runs of k words begin."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def holding(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, doc) for each row of items whose text is held in the text of a row of docs; null texts hold nothing and are held in none, an empty one is held in all.

    Words stand between blanks and line feeds; all but an item's first and last are whole words of every text that holds
    it. So an item of three or more words is looked up by up to three from its middle, and one of fewer in the different
    words, or pairs of words, of all texts, through an index of grams. What is found is compared as text. Each different
    text is looked up once; repeated rows are repeated in the result.
    """
    words = lambda c: F.split(c, r"[ \n]")
    b = items.select(F.col(text_col).alias("inner")).where("inner <> ''").distinct().withColumn("w", words("inner")).withColumn("n", F.size("w"))
    sizes = {r[0] for r in b.select(F.least("n", F.lit(5))).distinct().collect()}  # at most five values
    d = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null").withColumn("row", F.xxhash64("doc", "text"))
    w = d.select("row", words("text").alias("w"))
    hits = None

    def add(found: DataFrame) -> None:
        nonlocal hits
        hits = found if hits is None else hits.unionByName(found)

    def looked_up(k: int) -> DataFrame:
        """Items of k + 2 words (or more, for three) by their k middle ones."""
        key = lambda of, i: F.xxhash64(*(F.get(of, i + j) for j in range(k)))
        keys = w.select("row", F.explode(F.array_distinct(F.transform(_runs(F.col("w"), k), lambda i: key(F.col("w"), i)))).alias("key"))
        own = b.where(F.col("n") == k + 2 if k < 3 else F.col("n") >= k + 2)
        return keys.join(own.select("inner", key(F.col("w"), F.floor((F.col("n") - k) / 2).cast("int")).alias("key")), "key").select("row", "inner")

    def within(k: int) -> DataFrame:
        """Items of k words in runs of k words, with blanks for all that parts words."""
        run = lambda i: F.array_join(F.slice("w", i + 1, F.lit(k)), " ")
        each = w.select("row", F.explode(F.array_distinct(F.transform(_runs(F.col("w"), k), run))).alias("part"))
        one = F.lit(0).alias("folder")
        own = b.where(F.col("n") == k).select("inner", F.translate("inner", "\n", " ").alias("plain"))
        near = held_in(own.select(one, "plain"), each.select(one, "part"), "plain", "part")
        near = near.select(F.col("outer").alias("part"), F.col("inner").alias("plain")).join(own, "plain")
        return each.join(near, "part").select("row", "inner")

    for n in sorted(sizes):
        add(within(n) if n < 3 else looked_up(n - 2))
    told = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("inner"))
    empty = told.where("inner = ''").agg(F.collect_list("item").alias("items"))  # one row
    out = d.join(F.broadcast(empty)).select(F.explode("items").alias("item"), "doc")
    if hits is None:
        return out
    held = d.join(hits.distinct(), "row").where(F.contains("text", "inner")).select("doc", "inner")
    return out.unionByName(held.join(told, "inner").select("item", "doc"))
