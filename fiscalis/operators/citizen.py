"""Bundles for citizens: document text without geometry, private keys removed, lists keyed by county."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from fiscalis.functions.text import report_info, spoken_money, without_county
from fiscalis.operators.finance import last_of


def text_only(docs: DataFrame) -> DataFrame:
    """Documents with ids and non-empty cell texts; tables without such cells go."""
    keep = lambda t: F.filter(t["cells"], lambda c: F.trim(F.coalesce(c["raw_text"], F.lit(""))) != "")
    slim = lambda t: F.struct(
        t["table_id"].alias("table_id"), t["page_number"].alias("page_number"), F.transform(keep(t), lambda c: F.struct(c["row_idx"], c["col_idx"], c["raw_text"])).alias("cells")
    )
    return docs.withColumn("tables", F.filter(F.transform("tables", slim), lambda t: F.size(t["cells"]) > 0))


#: Fields of detection that no citizen reads, and amounts as they were printed.
DETECTION_FIELDS = ("bbox", "image_b64", "confidence", "match_score", "linked_table_id", "_profile", "text_source", "cell_type", "hierarchy_level", "row_span", "col_span", "cell_id")
PRINTED_FIELDS = ("amount_kshs_raw", "total_budget_kshs_raw", "executive_budget_kshs_raw", "assembly_budget_kshs_raw")


@dataclass(frozen=True)
class Unwanted:
    """Names of fields, and keys of maps, by the whole name, how it starts or how it ends."""

    names: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()

    def __call__(self, name: str) -> bool:
        return name in self.names or name.startswith(self.starts or "\0") or name.endswith(self.ends or "\0")

    def of(self, key: Column) -> Column:
        found = key.isin(*self.names) if self.names else F.lit(False)
        for test, parts in ((F.startswith, self.starts), (F.endswith, self.ends)):
            for x in parts:
                found = found | test(key, F.lit(x))
        return found


#: What a bundle leaves out in its last pass, and names for developers.
METADATA = Unwanted(names=DETECTION_FIELDS + PRINTED_FIELDS)
INTERNAL = Unwanted(starts=("_",))


def without_keys(df: DataFrame, unwanted: Unwanted | Callable[[str], bool]) -> DataFrame:
    """df without the fields, at any depth, whose names are unwanted, in structures, arrays and the values of maps; a structure of which nothing is left goes too. Of maps by text, entries with unwanted keys go as well, unless unwanted is a plain function, which can't be asked of data. The schema is walked on the driver."""
    return df.select(*(_kept(F.col(f"`{f.name}`"), f.dataType, unwanted).alias(f.name) for f in df.schema if _stays(f, unwanted)))


def _stays(field: StructField, unwanted: Unwanted | Callable[[str], bool]) -> bool:
    kind = field.dataType
    while isinstance(kind, ArrayType | MapType):
        kind = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
    return not unwanted(field.name) and (not isinstance(kind, StructType) or any(_stays(f, unwanted) for f in kind))


def _kept(value: Column, kind: DataType, unwanted: Unwanted | Callable[[str], bool]) -> Column:
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _kept(x, kind.elementType, unwanted))
    if isinstance(kind, MapType):
        if isinstance(unwanted, Unwanted) and isinstance(kind.keyType, StringType):
            value = F.map_filter(value, lambda k, _: ~unwanted.of(k))
        return F.transform_values(value, lambda _, v: _kept(v, kind.valueType, unwanted))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_kept(value[f.name], f.dataType, unwanted).alias(f.name) for f in kind if _stays(f, unwanted))))
    return value


def by_county(rows: DataFrame, order: str, key: str = "county") -> DataFrame:
    """One row: a map from county to its last row without the key, and the number of counties; blank keys are left out."""
    found = last_of(rows.where(F.trim(F.coalesce(key, F.lit(""))) != ""), [key], [order])
    rest = [c for c in found.columns if c not in (key, order)]
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)  # noqa: E731  keys differ; values may be of kinds without an order
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*rest).alias("value"))), by_key)
    return found.agg(F.map_from_entries(entries).alias("counties"), F.count("*").alias("total_counties"))


#: What is said of a flagged project without a note of its own.
NO_NOTE = "Stalled completion due to substandard materials used."


def narrated(projects: DataFrame, key: str = "county") -> DataFrame:
    """What is read out about each county's projects, in the order of idx. projects: key, idx, title, contract_sum (as shown), progress, oag_status, oag_detail; missing sums and progress are not mentioned."""
    line = F.concat(
        F.lit("Item "), F.col("place").cast("string"), F.lit(": "), F.col("title"), F.lit(". "),
        F.when(F.coalesce("contract_sum", F.lit("")) != "", F.concat(F.lit("The designated contract sum is "), spoken_money(F.col("contract_sum")), F.lit(". "))).otherwise(""),
        F.when(F.col("progress").isNotNull(), F.concat(F.lit("Current execution implementation is at "), F.col("progress").cast("string"), F.lit(" percent. "))).otherwise(""),
        F.when(
            F.col("oag_status") == "FLAGGED",
            F.concat(
                F.lit("Warning. This project profile reflects a verified project risk indicator from the Office of the Auditor General. Observation note indicates: "),
                F.coalesce(F.nullif("oag_detail", F.lit("")), F.lit(NO_NOTE)), F.lit(" "),
            ),
        ).otherwise(""),
        F.lit(" "),
    )
    placed = projects.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("idx")))
    d = placed.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    head = F.concat(F.lit("Displaying telemetry summary for "), F.col(key), F.lit(" County, containing "), F.col("n").cast("string"), F.lit(" project records. "))
    return d.select(key, F.concat(head, F.col("lines")).alias("narration"))


def preview(projects: DataFrame, line: Column, *order: Column, key: str = "county", n: int = 5) -> DataFrame:
    """What is read out of each county's first projects, and how many there are."""
    placed = projects.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("_line", line)
    d = placed.groupBy(key).agg(F.count("*").alias("_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_k") <= n, F.struct("_k", "_line")))), lambda x: x["_line"]), " ").alias("_lines"))
    said = F.concat(F.col(key), F.lit(" has "), F.col("_n").cast("string"), F.lit(" projects, "), F.least("_n", F.lit(n)).cast("string"), F.lit(" shown. "), F.col("_lines"))
    return d.select(key, said.alias("narration"))


def no_projects(county: Column) -> Column:
    return F.concat(F.lit("There are currently no active project metrics recorded for "), county, F.lit(" County."))


def bundle_total(first: Column, second: Column) -> Column:
    """The counties of a bundle of two maps: the larger number, 1 at least."""
    return F.greatest(F.coalesce(F.size(F.map_keys(first)), F.lit(0)), F.coalesce(F.size(F.map_keys(second)), F.lit(0)), F.lit(1))


def bundle(sections: dict[str, DataFrame], reports: DataFrame, fiscal_year: str, generated_at: str, order: str = "idx", keep_internal: bool = False) -> DataFrame:
    """One row: metadata, each section (named group.section) as {by_county, total_counties} below its group, reports with their text only, and total_counties, the most that a section has. What detection and developers need alone is left out.

    sections: county, order and their columns, the last row of a county counts; reports: file and tables, as
    text_only() takes them. A section is one map, bounded by the number of counties.
    """
    row = None
    for name, rows in sections.items():
        one = by_county(rows.withColumn("county", without_county(F.trim("county"))), order).select(F.struct(F.col("counties").alias("by_county"), "total_counties").alias(name))
        row = one if row is None else row.join(one)  # one row each
    told = text_only(reports).select(F.struct("file", "tables", report_info(F.col("file")).alias("info")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("reports"))
    row = told if row is None else row.join(told)
    groups: dict[str, list] = {}
    for name in sections:
        group, section = name.split(".", 1)
        groups.setdefault(group, []).append(F.col(f"`{name}`").alias(section))
    meta = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(fiscal_year).alias("fiscal_year"))
    total = F.greatest(F.lit(1), F.lit(1), *(F.coalesce(F.col(f"`{name}`.total_counties"), F.lit(0)) for name in sections))
    d = without_keys(row.select(meta.alias("metadata"), *(F.struct(*parts).alias(g) for g, parts in groups.items()), "reports", total.cast("long").alias("total_counties")), METADATA)
    return d if keep_internal else without_keys(d, INTERNAL)
