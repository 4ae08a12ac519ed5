"""Queries on shapes of maps, names held in names, and bundles for citizens."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis.functions import geometry as G
from fiscalis.operators import annotation, citizen, maps
from fiscalis.plans.registry import query

SHAPES = """s AS (SELECT c_custkey AS k, c_custkey % 3 AS kind, 33 + (c_custkey % 80) / 10.0::DOUBLE AS lon, -5 + (c_custkey % 97) / 10.0::DOUBLE AS lat, 0.1::DOUBLE + (c_custkey % 7) / 20.0::DOUBLE AS w, 0.1::DOUBLE + (c_custkey % 5) / 20.0::DOUBLE AS h FROM customer),
 r AS (SELECT k, 1 AS way, lon AS a, lat AS b, lon + w AS c, lat + h AS d FROM s UNION ALL SELECT k, -1, lon + w / 4, lat + h / 4, lon + w / 2, lat + h / 2 FROM s WHERE kind > 0 UNION ALL SELECT k, 1, lon + 1, lat + 1, lon + 1 + h, lat + 1 + w FROM s WHERE kind = 2),
 p AS (SELECT k, way, radians(a) AS x1, radians(c) AS x2, -ln(tan(pi() / 4 + radians(d) / 2)) AS y1, -ln(tan(pi() / 4 + radians(b) / 2)) AS y2 FROM r), m AS (SELECT min(x1) AS lx, max(x2) AS hx, min(y1) AS ly, max(y2) AS hy FROM p),
 f AS (SELECT *, least(400 / (hx - lx), 450 / (hy - ly)) AS s FROM m), q AS (SELECT k, sum(way * (x2 - x1) * (y2 - y1)) AS area, sum(way * (x2 - x1) * (y2 - y1) * (x1 + x2) / 2) AS sx, sum(way * (x2 - x1) * (y2 - y1) * (y1 + y2) / 2) AS sy FROM p GROUP BY 1)"""


@query(f"WITH {SHAPES} SELECT k AS c_custkey, round(area * s * s, 3) AS area, round(sx / area * s + (400 - s * (hx + lx)) / 2, 3) AS x, round(sy / area * s + (450 - s * (hy + ly)) / 2, 3) AS y FROM q, f")
def map_labels(t):
    """Customers as counties: a rectangle, one with a hole, or with a second one besides, as GeoJSON text; rings turn either way, some are closed."""
    k = F.col("c_custkey")
    lon, lat, w, h = 33 + k % 80 / F.lit(10.0), -5 + k % 97 / F.lit(10.0), 0.1 + k % 7 / F.lit(20.0), 0.1 + k % 5 / F.lit(20.0)

    def ring(a, b, c, d, closed):
        at = lambda x, y: F.format_string("[%s,%s]", x.cast("string"), y.cast("string"))
        corners = F.when(k % 2 == 0, F.array(at(a, b), at(c, b), at(c, d), at(a, d))).otherwise(F.array(at(a, b), at(a, d), at(c, d), at(c, b)))
        return F.concat(F.lit("["), F.array_join(F.when(closed, F.concat(corners, F.array(at(a, b)))).otherwise(corners), ","), F.lit("]"))

    border, hole, other = ring(lon, lat, lon + w, lat + h, k % 4 < 2), ring(lon + w / 4, lat + h / 4, lon + w / 2, lat + h / 2, k % 5 < 2), ring(lon + 1, lat + 1, lon + 1 + h, lat + 1 + w, k % 3 < 2)
    text = F.when(k % 3 == 0, F.concat(F.lit("["), border, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit("["), border, F.lit(","), hole, F.lit("]"))).otherwise(F.concat(F.lit("[["), border, F.lit(","), hole, F.lit("],["), other, F.lit("]]")))
    d = t("customer").select("c_custkey", G.polygons(F.when(k % 3 < 2, "Polygon").otherwise("MultiPolygon"), text).alias("polygons"))
    return maps.labels(d, ["c_custkey"]).select("c_custkey", *(F.round(c, 3).alias(c) for c in ("area", "x", "y")))


@query("""WITH a AS (SELECT DISTINCT p_brand AS folder, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_name || ' ' || p_type WHEN 3 THEN p_name[1:2] ELSE p_type || p_partkey END AS name FROM part WHERE p_partkey % 2 = 0),
 b AS (SELECT DISTINCT p_brand AS folder, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_type ELSE p_name[3:] END AS file FROM part WHERE p_partkey % 2 = 1)
 SELECT folder, name, file FROM a JOIN b USING (folder) WHERE contains(file, name) OR contains(name, file) QUALIFY row_number() OVER (PARTITION BY folder, name ORDER BY name <> file, file) = 1""")
def names_of_files(t):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 1, F.col("p_type")).when(k % 5 == 2, F.concat_ws(" ", "p_name", "p_type")).when(k % 5 == 3, F.substring("p_name", 1, 2)).otherwise(F.concat("p_type", k.cast("string")))
    file = F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_type")).when(k % 3 == 1, F.col("p_type")).otherwise(F.expr("substring(p_name, 3)"))
    a, b = (t("part").where(k % 2 == side).select(F.col("p_brand").alias("folder"), c.alias(n)) for side, c, n in ((0, name, "name"), (1, file, "file")))
    return annotation.same_name(a, b)


@query("""WITH o AS (SELECT n_name AS county, o_orderkey, o_orderstatus, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), l AS (SELECT county, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS k FROM o GROUP BY 1)
 SELECT county, status, CASE WHEN k % 2 = 0 THEN 'note:' || k END AS notes, (SELECT count(*) FROM l) AS total_counties FROM l""")
def citizen_bundle(t):
    """Counties with their last order below a map by county; fields of detection and for developers are left out of structures, arrays and maps."""
    of = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.concat("n_name", F.lit(" County")).alias("county"))
    k = F.col("o_orderkey")
    notes = F.create_map(F.lit("note"), F.struct(k.alias("n"), F.lit(1).alias("cell_id")), F.lit("_draft"), F.struct(k.alias("n"), F.lit(2).alias("cell_id")), F.lit("bbox"), F.struct(k.alias("n"), F.lit(3).alias("cell_id")))
    rows = t("orders").join(of, "o_custkey").select(
        "county", k.alias("idx"), F.col("o_orderstatus").alias("status"), F.lit("x").alias("_columns"), F.lit(0.5).alias("confidence"), F.array(F.struct(F.when(k % 2 == 0, notes).alias("by_kind"), F.lit("KES").alias("amount_kshs_raw"))).alias("more")
    )
    cell = F.struct(F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("text").alias("raw_text"))
    reports = t("nation").select(F.concat(F.lower("n_name"), F.lit("-oag.pdf")).alias("file"), F.array(F.struct(F.lit("t").alias("table_id"), F.lit(1).alias("page_number"), F.array(cell).alias("cells"))).alias("tables"))
    d = citizen.bundle({"projects.stalled": rows, "finance.budget": rows.where(k % 3 == 0)}, reports, "2023-2024", "now")
    each = d.select("total_counties", F.explode("projects.stalled.by_county").alias("county", "c"))
    notes = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), F.to_json(e["value"]))), ",")
    return each.select("county", "c.status", F.regexp_replace(notes(F.col("c.more")[0]["by_kind"]), r"\{\"n\":(\d+)\}", "$1").alias("notes"), "total_counties")
