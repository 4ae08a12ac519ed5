"""Column functions on boxes (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without a union."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def meets(a: Box, b: Box) -> Column:
    """Whether two boxes share more than an edge."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def overlap(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 if that is none."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def clamped(b: Box, width: Column, height: Column) -> Box:
    """Inside the page, at least one unit wide and high."""
    x1 = F.least(F.greatest(b[0], F.lit(0)), width - 1)
    y1 = F.least(F.greatest(b[1], F.lit(0)), height - 1)
    return x1, y1, F.least(F.greatest(b[2], x1 + 1), width), F.least(F.greatest(b[3], y1 + 1), height)


def plausible(b: Box, width: Column, height: Column) -> Column:
    """Whether a raw box can be a table: valid, not over 5 units off the left or upper edge, and, cut to the page, 1 % of it or more, 15 % of its width or more, not over 10 times as high as wide."""
    wide = F.least(b[2], width) - F.greatest(b[0], F.lit(0))
    high = F.least(b[3], height) - F.greatest(b[1], F.lit(0))
    valid = (b[2] > b[0]) & (b[3] > b[1]) & (b[0] >= -5) & (b[1] >= -5) & (wide > 0) & (high > 0)
    return valid & (wide * high >= 0.01 * width * height) & (wide >= 0.15 * width) & (high <= 10 * wide)


def tiny(b: Box, width: Column, height: Column) -> Column:
    """Whether a box is too small to be trusted: under 100 units on one side, or under 0.2 % of the page."""
    wide, high = b[2] - b[0], b[3] - b[1]
    return (wide < 100) | (high < 100) | (wide * high < 0.002 * width * height)


def centre_distance(a: Box, b: Box) -> Column:
    """How far the centres are apart, across plus down."""
    return F.abs((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) + F.abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def holds_centre(outer: Box, inner: Box) -> Column:
    """Whether the centre of the inner box is in the outer one, edges included."""
    x, y = (inner[0] + inner[2]) / 2, (inner[1] + inner[3]) / 2
    return x.between(outer[0], outer[2]) & y.between(outer[1], outer[3])


def pixels(points: Column, dpi: int = 300) -> Column:
    return points * dpi / 72


def points(pixels_: Column, dpi: int = 300) -> Column:
    return pixels_ * 72 / dpi


def of_percent(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """A box in whole pixels, cut to the image, from percentages of it."""
    at = lambda part, size: F.greatest(F.lit(0), F.least((part / 100.0 * size).cast("int"), size))
    return at(x, width), at(y, height), at(x + w, width), at(y + h, height)


def on_map(lat: Column, lon: Column) -> Column:
    """Whether a place lies within the bounds of the map."""
    return lat.between(-4.9, 5.5) & lon.between(33.8, 41.9)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Places of a Mercator projection on the unit sphere, x to the east and y to the north."""
    return F.radians(lon), F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


POLYGON = "array<array<array<double>>>"


def polygons(kind: Column, coordinates: Column) -> Column:
    """The polygons of a GeoJSON geometry, given as text: arrays of rings of points (x, y); null for other kinds and texts that aren't coordinates. The first ring of a polygon is its border, the others are holes."""
    many = F.when(kind == "Polygon", F.array(F.from_json(coordinates, POLYGON))).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{POLYGON}>"))
    return F.transform(many, lambda p: F.transform(p, lambda ring: F.transform(ring, lambda at: F.struct(F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y")))))


def ring_sums(ring: Column) -> Column:
    """Of a ring of points: its signed area by the shoelace rule, and the area times the centre's place; the last point is joined to the first."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def step(s: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        z = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((s["a"] + z / 2).alias("a"), (s["sx"] + (p["x"] + q["x"]) * z / 6).alias("sx"), (s["sy"] + (p["y"] + q["y"]) * z / 6).alias("sy"))

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), start, step)


def padded(b: Box, pad: int, width: Column, height: Column) -> Box:
    return F.greatest(b[0] - pad, F.lit(0)), F.greatest(b[1] - pad, F.lit(0)), F.least(b[2] + pad, width), F.least(b[3] + pad, height)


def centred(b: Box, width: Column, height: Column) -> Box:
    """Centre, width and height as parts of the page."""
    return (b[0] + b[2]) / 2 / width, (b[1] + b[3]) / 2 / height, (b[2] - b[0]) / width, (b[3] - b[1]) / height
