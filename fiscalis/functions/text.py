"""Column functions on strings: names, numbers, file names and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed words by which reports are classed.
AUDIT_WORDS = ("auditor", "oag")
BUDGET_WORDS = ("green-book", "budget-implementation", "cob")


def county_words(name: Column) -> Column:
    """Lower case, trimmed, with blanks, apostrophes, hyphens and slashes as one blank."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s'\-/]+", " ")


def without_county(name: Column) -> Column:
    """Without a trailing word "County", in any case."""
    return F.regexp_replace(name, r"(?i)\s+County\s*$", "")


def county_key(name: Column) -> Column:
    """One key for the three ways in which counties are named."""
    return county_words(without_county(name))


def title_case(text: Column) -> Column:
    """Each run of letters with its first one upper and the rest lower, so that O'BRIEN becomes O'Brien."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def report_title(stem: Column) -> Column:
    """A file's name as a title: hyphens as blanks, each word with a capital."""
    return title_case(F.replace(stem, F.lit("-"), F.lit(" ")))


def plain(text: Column) -> Column:
    """Lower case, trimmed, white space as one blank; null as empty."""
    return F.coalesce(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), F.lit(""))


def money(text: Column) -> Column:
    """A number with thousands commas; null if it is none."""
    return F.regexp_replace(text.cast("string"), ",", "").try_cast("decimal(20,2)")


def numeric_cell(text: Column) -> tuple[Column, Column]:
    """The first number in a table cell (null if none) and whether the cell is a percentage."""
    t = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit(","), F.lit(""))
    percent = t.endswith("%")
    number = F.regexp_extract(F.replace(t, F.lit(" "), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.nullif(number, F.lit("")).try_cast("double"), percent


def leading_int(text: Column) -> Column:
    """The whole number with which a text begins; null if with none."""
    return F.nullif(F.regexp_extract(F.ltrim(text), r"^[+-]?\d+", 0), F.lit("")).try_cast("int")


def project_id(county: Column, name: Column) -> Column:
    """A lossy key: four letters of the county and the first ten letters or digits of the name."""
    return F.concat(F.lower(F.substring(county, 1, 4)), F.lit("-"), F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, 10))


def short_stem(stem: Column) -> Column:
    """At most 50 characters; longer ones are cut and told apart by 8 digits of their SHA-256."""
    return F.when(F.length(stem) > 50, F.concat(F.substring(stem, 1, 41), F.lit("-"), F.substring(F.sha2(stem.cast("binary"), 256), 1, 8))).otherwise(stem)


def base_name(url: Column) -> Column:
    """The file name in an address: behind the first ?d= if there, decoded (a plus stays one), either slash."""
    path = F.when(F.instr(url, F.lit("?d=")) > 0, F.element_at(F.split(url, r"\?d=", 2), -1)).otherwise(url)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.element_at(F.split(F.replace(F.coalesce(decoded, path), F.lit("\\"), F.lit("/")), "/"), -1)


def report_class(name: Column) -> Column:
    """Audit, Budget or Report by words in a file name."""
    return F.when(_has(name, AUDIT_WORDS), "Audit").when(_has(name, BUDGET_WORDS), "Budget").otherwise("Report")


def _has(name: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(name), w))


def report_info(name: Column) -> Column:
    """Institution, family and context of a report by words in its file name; other reports have no context."""
    kind = report_class(name)
    pick = lambda audit, budget, other: F.when(kind == "Audit", audit).when(kind == "Budget", budget).otherwise(F.lit(other))
    return F.struct(
        pick("Office of the Auditor General (OAG)", "Controller of Budget (COB)", "Unknown").alias("institution"), kind.alias("report_family"),
        pick("Financial integrity, project status, and audit opinions", "County budget allocations and actual expenditure", None).alias("data_context"),
    )


def relevant_report(name: Column, fiscal_year: str) -> Column:
    """Whether a file name has a word of either kind and the year, or one of the years 2023 and 2024."""
    low = F.lower(name)
    return _has(name, AUDIT_WORDS + BUDGET_WORDS) & (F.contains(low, F.lit(fiscal_year)) | F.contains(low, F.lit("2023")) | F.contains(low, F.lit("2024")))


def clean_name(name: Column) -> Column:
    """A project's name without the numbers behind it; no name gives one of its own."""
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown Project").otherwise(F.regexp_replace(name, r"(?:\s+[\d.,]+)+\s*$", ""))


def risk_label(risks: Column, verdict: Column, status: Column) -> Column:
    """The first risk, else the verdict, else the status, else FLAGGED, with blanks for underscores."""
    return F.translate(F.coalesce(F.get(risks, F.lit(0)), verdict, status, F.lit("FLAGGED")), "_", " ")


def cell_id(page: Column, table: Column, row: Column | None = None, col: Column | None = None) -> Column:
    """page_001_table_00, and of a cell with _r0_c0 behind it."""
    pad = lambda x, n: F.when(F.length(x.cast("string")) < n, F.lpad(x.cast("string"), n, "0")).otherwise(x.cast("string"))
    own = F.concat(F.lit("page_"), pad(page, 3), F.lit("_table_"), pad(table, 2))
    return own if row is None else F.concat(own, F.lit("_r"), row.cast("string"), F.lit("_c"), col.cast("string"))


def joined_pieces(word: Column, amount: bool = False) -> Column:
    """A word put together from a tagger's pieces: marks of inner pieces go, and in amounts all blanks."""
    whole = F.replace(F.replace(word, F.lit(" ##"), F.lit("")), F.lit("##"), F.lit(""))
    return F.trim(F.replace(whole, F.lit(" "), F.lit("")) if amount else whole)


#: The names of a tagger's numbered labels.
TAGS = {"0": "O", "1": "B-COUNTY", "2": "I-COUNTY", "3": "B-AMOUNT", "4": "I-AMOUNT"}


def tag_name(label: Column) -> Column:
    """The name of a label, looked up by its number, without B- or I-; one that isn't there stays as it is; null for the label 0, which is left out."""
    number = F.replace(label, F.lit("LABEL_"), F.lit(""))
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair]), number), number)
    return F.when(number != "0", F.replace(F.replace(name, F.lit("B-"), F.lit("")), F.lit("I-"), F.lit("")))


def percent_text(share: Column) -> Column:
    """97.1% for 0.971: two decimals at most."""
    return F.concat(F.round(share * 100, 2).cast("string"), F.lit("%"))


def full_money(x: Column) -> Column:
    """KES and the whole amount with commas; no amount is 0, commas in a text are left out."""
    return F.concat(F.lit("KES "), F.format_number(F.coalesce(F.replace(x.cast("string"), F.lit(","), F.lit("")).try_cast("decimal(20,2)"), F.lit(0)), 0))


def spoken_money(text: Column) -> Column:
    """An amount as it is read out."""
    for mark in ("Ksh", "KES"):
        text = F.replace(text, F.lit(mark), F.lit("Kenyan Shillings"))
    return text


def page_heading(number: Column, text: Column) -> Column:
    return F.concat(F.lit("## PAGE "), number.cast("string"), F.lit("\n\n"), text)


def joined_blocks(blocks: Column) -> Column:
    """Blocks of text, trimmed, one to a line, blank ones left out."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: b != ""), "\n")


def sentences(text: Column) -> Column:
    """Stretches of text that end with a full stop, an exclamation or a question mark before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def compact_money(x: Column) -> Column:
    """KES with one decimal in billions or millions, else whole."""
    def form(y: Column, digits: int, mark: str) -> Column:
        return F.concat(F.lit("KES "), F.format_number(y, digits), F.lit(mark))

    return F.when(x >= 1e9, form(x / 1e9, 1, "B")).when(x >= 1e6, form(x / 1e6, 1, "M")).otherwise(form(F.coalesce(x, F.lit(0)), 0, ""))


def one_decimal(x: Column) -> Column:
    """A number with one decimal, as C prints it: the nearest to the number as it is stored, not to its shortest text, and of two that are as near the even one; from 2^44 on, by its text."""
    a = F.when(F.abs(x) < 2.0**44, F.abs(x))
    n = F.floor(a * 10)  # of the product as it is rounded, so perhaps one too high: then a is far below the middle behind it
    most, more = a * 16, a * 4  # exact; so is their sum, with what it loses
    total = most + more
    back = total - most
    lost = (most - (total - back)) + (more - back)
    over = (total - (2 * n + 1)) + lost  # 20 a against the middle between n and n + 1 tenths
    up = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    whole = F.floor(up / 10)
    told = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), whole.cast("string"), F.lit("."), (up - whole * 10).cast("string"))
    return F.when(a.isNotNull(), told).otherwise(F.when(x.isNotNull(), F.format_string("%.1f", x)))


def rounded(x: Column, digits: int) -> Column:
    """x to the nearest multiple of a power of ten, as the scaled number is rounded; F.round() goes by the number's shortest text, which can be just at a half where the number itself is below."""
    scale = 10.0**digits
    return F.round(x * scale) / scale
