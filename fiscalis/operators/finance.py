"""County finances: merging the three lists of a finance bundle, totals, ratios, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.functions.text import leading_int


def last_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys, the last in the given order; found before the shuffle in each task, then among these."""
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def merge(budget: DataFrame, revenue: DataFrame, expenditure: DataFrame, key: str = "county", order: str | None = None) -> DataFrame:
    """One row per county of any list; a list without it leaves its columns null. Of several rows of a county in one list the last by the column `order` counts; without such a column each list has a county once."""
    if order:
        budget, revenue, expenditure = (last_of(d, [key], [order]).drop(order) for d in (budget, revenue, expenditure))
    return budget.join(revenue, key, "full_outer").join(expenditure, key, "full_outer")


def totals(finances: DataFrame) -> DataFrame:
    return finances.agg(
        F.sum(F.coalesce("total_budget", F.lit(0))).cast("decimal(20,2)").alias("total_budget"),
        F.sum(F.coalesce("total_expenditure", F.lit(0))).cast("decimal(20,2)").alias("total_expenditure"), F.count("*").alias("counties"),
    )


def achievement(finances: DataFrame, percent: str = "achievement_pct") -> DataFrame:
    """Adds the width of the bar, at most 100, and whether the target is met."""
    p = leading_int(F.col(percent))
    return finances.withColumn("bar", F.least(F.coalesce(p, F.lit(0)), F.lit(100))).withColumn("met", F.coalesce(p >= 100, F.lit(False)))


def search(finances: DataFrame, text: str, name: str = "county") -> DataFrame:
    """Counties whose name holds the text, in any case; an empty text finds all."""
    return finances.where(F.contains(F.lower(name), F.lit(text.lower())))
