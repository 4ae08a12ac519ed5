"""Maps: polygons of counties on a projection that is fitted to them, with areas and the places of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.functions.geometry import mercator, ring_sums


def rings(features: DataFrame, keys: list[str], polygons: str = "polygons") -> DataFrame:
    """One row per ring: keys, polygon, ring (0: the border, others: holes), points (x, y), without the closing point that repeats the first, and without points that lack a coordinate. Rings without a point are left out."""
    each = features.select(*keys, F.posexplode(polygons).alias("polygon", "p")).select(*keys, "polygon", F.posexplode("p").alias("ring", "points"))
    whole = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    d = each.withColumn("points", whole).where(F.size("points") > 0)
    closed = (F.size("points") > 1) & (F.get("points", F.lit(0)) == F.get("points", F.size("points") - 1))
    return d.withColumn("points", F.when(closed, F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points")))


def projected(found: DataFrame) -> DataFrame:
    """Rings of degrees as rings on the Mercator plane, y to the south as on a screen."""

    def place(p):
        x, y = mercator(p["y"], p["x"])
        return F.struct(x.alias("x"), (-y).alias("y"))

    return found.withColumn("points", F.transform("points", place))


def fit(found: DataFrame, width: float, height: float) -> DataFrame:
    """One row (k, tx, ty): scale and shift that bring all points into the middle of a picture, as large as fits."""
    side = lambda c: F.transform("points", lambda p: p[c])
    d = found.agg(*(whole(of(side(c))).alias(f"{name}_{c}") for c in ("x", "y") for name, whole, of in (("low", F.min, F.array_min), ("high", F.max, F.array_max))))
    wide, high = F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")
    k = F.least(F.when(wide > 0, width / wide), F.when(high > 0, height / high))  # of nulls, the other one
    d = d.withColumn("k", F.coalesce(k, F.lit(1.0)))
    return d.select("k", ((width - F.col("k") * (F.col("high_x") + F.col("low_x"))) / 2).alias("tx"), ((height - F.col("k") * (F.col("high_y") + F.col("low_y"))) / 2).alias("ty"))


def centroids(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, x, y): the area of all polygons without their holes, whichever way their rings turn, and its centre; for shapes without area the mean of their points."""
    s = ring_sums(F.col("points"))
    way = F.when(F.col("s.a") < 0, -1.0).otherwise(1.0) * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    mean = lambda c: F.aggregate("points", F.lit(0.0), lambda t, p: t + p[c])
    d = found.withColumn("s", s).select(*keys, *((F.col(f"s.{c}") * way).alias(c) for c in ("a", "sx", "sy")), mean("x").alias("mx"), mean("y").alias("my"), F.size("points").alias("n"))
    d = d.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("a", "sx", "sy", "mx", "my", "n")))
    at = lambda c: F.when(F.abs("a") > 1e-12, F.col(f"s{c}") / F.col("a")).otherwise(F.col(f"m{c}") / F.col("n"))
    return d.select(*keys, F.col("a").alias("area"), at("x").alias("x"), at("y").alias("y"))


def labels(features: DataFrame, keys: list[str], width: float = 400, height: float = 450) -> DataFrame:
    """(keys, area, x, y) of each feature in a picture of that size into which all of them are fitted; features without a polygon have no row. features: keys, polygons."""
    plane = projected(rings(features, keys))
    d = centroids(plane, keys).join(F.broadcast(fit(plane, width, height)))  # one row
    return d.select(*keys, (F.col("area") * F.col("k") * F.col("k")).alias("area"), (F.col("x") * F.col("k") + F.col("tx")).alias("x"), (F.col("y") * F.col("k") + F.col("ty")).alias("y"))


def outlines(features: DataFrame, keys: list[str], width: float = 400, height: float = 450) -> DataFrame:
    """(keys, path): each feature as a path of lines in a picture of that size, a closed stretch for each ring, places with three decimals."""
    plane = projected(rings(features, keys))
    d = plane.join(F.broadcast(fit(plane, width, height)))  # one row
    at = lambda p: F.concat((F.round(p["x"] * F.col("k") + F.col("tx"), 3)).cast("string"), F.lit(","), (F.round(p["y"] * F.col("k") + F.col("ty"), 3)).cast("string"))
    line = F.concat(F.lit("M"), F.array_join(F.transform("points", at), "L"), F.lit("Z"))
    return d.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("polygon", "ring", line.alias("line")))), lambda x: x["line"]), "").alias("path"))
