"""Terrain as cells: parts laid out on a grid of 50 columns, their price as elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import cells, depressions
from sluice.registry import add
from sluice.session import written

from .base import table


def raster(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.floor(F.col("p_partkey") / 50).alias("y"), (F.col("p_partkey") % 50).alias("x"), F.round(F.col("p_retailprice") / 100 + F.col("p_partkey") * 37 % 11 / 10, 3).alias("z"), F.col("p_brand").alias("district"))


CELLS = "cells AS (SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, round(p_retailprice / 100 + p_partkey * 37 % 11 / 10, 3) AS z, p_brand AS district FROM part)"
_NEAR = "cells c LEFT JOIN cells w ON w.y = c.y AND w.x = c.x - 1 LEFT JOIN cells e ON e.y = c.y AND e.x = c.x + 1 LEFT JOIN cells n ON n.x = c.x AND n.y = c.y - 1 LEFT JOIN cells s ON s.x = c.x AND s.y = c.y + 1"
_grad = lambda a, b: f"coalesce((coalesce({b}.z, c.z) - coalesce({a}.z, c.z)) / nullif((({a}.z IS NOT NULL)::INT + ({b}.z IS NOT NULL)::INT) * 5, 0), 0)"
SLOPES = f"{CELLS}, slopes AS (SELECT c.y, c.x, c.z, c.district, round(degrees(atan(sqrt(pow({_grad('w', 'e')}, 2) + pow({_grad('n', 's')}, 2)))), 6) AS slope FROM {_NEAR})"
slopes = lambda s, d: cells.slopes(raster(s, d), 5.0)
add("d32_slope", slopes, f"WITH {SLOPES} SELECT * FROM slopes")
add("d32_ground", lambda s, d: cells.ground(raster(s, d), 2, 1.0),
    f"WITH {CELLS} SELECT c.*, low, z - low <= 1.0 AS is_ground FROM cells c JOIN (SELECT a.y, a.x, min(b.z) AS low FROM cells a JOIN cells b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2) USING (y, x)")
RECEIVERS = f"""{CELLS}, around(k, dy, dx) AS (VALUES {', '.join(str((k, *s)) for k, s in enumerate(cells.AROUND))}),
drops AS (SELECT a.y, a.x, b.y AS to_y, b.x AS to_x, k, round((a.z - b.z) / (5 * sqrt(abs(dy) + abs(dx))), 9) AS d FROM cells a, around JOIN cells b ON b.y = a.y + dy AND b.x = a.x + dx),
best AS (SELECT y, x, to_y, to_x FROM drops WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY d DESC, k) = 1),
receivers AS (SELECT y, x, to_y, to_x FROM cells LEFT JOIN best USING (y, x))"""
add("d32_receivers", lambda s, d: cells.receivers(raster(s, d), 5.0), f"WITH {RECEIVERS} SELECT * FROM receivers")


def drained(spark: SparkSession, sf: str) -> DataFrame:
    return cells.accumulation(written(cells.receivers(raster(spark, sf), 5.0), "cells"), lambda df: written(df, "cells"))


add("d32_accumulation", drained,
    f"""WITH RECURSIVE {RECEIVERS}, way(y, x) AS (SELECT y, x FROM receivers UNION ALL SELECT r.to_y, r.to_x FROM way JOIN receivers r USING (y, x) WHERE r.to_y IS NOT NULL)
    SELECT y, x, count(*) AS cells FROM way GROUP BY 1, 2""")  # fmt: skip
add("d33_district_terrain", lambda s, d: cells.district_terrain(slopes(s, d), 12.0),
    f"""WITH {SLOPES} SELECT district, count(*) AS n_cells, round(avg(z), 6) AS elevation, round(max(z) - min(z), 6) AS relief, round(avg(slope), 6) AS slope,
    round(avg((z < 12.0)::INT), 6) AS low_share FROM slopes GROUP BY 1""")  # fmt: skip
add("d33_sample_points", lambda s, d: cells.sample_points(table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 60 * 5.0 + 1).alias("east"), (F.col("s_suppkey") % 7 * 3.0).alias("north")), raster(s, d), 5.0),
    f"""WITH {CELLS}, p AS (SELECT s_suppkey, s_suppkey % 60 * 5.0::DOUBLE + 1 AS east, s_suppkey % 7 * 3.0::DOUBLE AS north FROM supplier)
    SELECT s_suppkey, east, north, z FROM p LEFT JOIN cells ON y = floor(north / 5) AND x = floor(east / 5)""")  # fmt: skip

# -- hollows: tiles of 32 cells, so that several meet even in a small raster -----------------------------------
TILE = 32
_EIGHT = ", ".join(str(step) for step in cells.AROUND)
FILLED = f"""{CELLS}, eight(dy, dx) AS (VALUES {_EIGHT}),
outlets AS (SELECT y, x, z FROM cells c WHERE (SELECT count(*) FROM cells n WHERE (n.x = c.x AND abs(n.y - c.y) = 1) OR (n.y = c.y AND abs(n.x - c.x) = 1)) < 4),
spill(y, x, level) USING KEY (y, x) AS (
    SELECT y, x, z FROM outlets
    UNION
    SELECT c.y, c.x, min(greatest(c.z, w.level)) AS level FROM spill w, eight JOIN cells c ON c.y = w.y + dy AND c.x = w.x + dx
    LEFT JOIN recurring.spill k ON k.y = c.y AND k.x = c.x WHERE k.level IS NULL OR greatest(c.z, w.level) < k.level GROUP BY 1, 2),
filled AS (SELECT y, x, level AS filled FROM spill),
hollows AS (SELECT y, x, z, filled, CASE WHEN round(filled - z, 6) >= 0.05 THEN round(filled - z, 6) ELSE 0 END AS depth FROM cells JOIN filled USING (y, x)),
routed AS (SELECT y, x, round(filled - 0.001::DOUBLE * (filled - z), 9) AS z FROM hollows)"""
hollows = lambda s, d: depressions.hollows(raster(s, d), tile=TILE)
routed = lambda s, d: depressions.routing_surface(hollows(s, d))
add("d32_fill", lambda s, d: depressions.filled(raster(s, d), TILE), f"WITH RECURSIVE {FILLED} SELECT * FROM filled")
add("d32_depression_depth", hollows, f"WITH RECURSIVE {FILLED} SELECT * FROM hollows")
add("d32_routing_surface", routed, f"WITH RECURSIVE {FILLED} SELECT * FROM routed")


def wet(spark: SparkSession, sf: str) -> DataFrame:
    """Wetness of the cells by what runs through them over the routing surface."""
    drains = cells.accumulation(written(cells.receivers(routed(spark, sf), 5.0), "cells"), lambda df: written(df, "cells"))
    return depressions.wetness(slopes(spark, sf), drains, 5.0)


add("d32_wetness", wet,
    f"""WITH RECURSIVE {FILLED}, {RECEIVERS[len(CELLS) + 2:].replace('FROM cells a, around JOIN cells b', 'FROM routed a, around JOIN routed b')},
    way(y, x) AS (SELECT y, x FROM receivers UNION ALL SELECT r.to_y, r.to_x FROM way JOIN receivers r USING (y, x) WHERE r.to_y IS NOT NULL),
    drained AS (SELECT y, x, count(*) AS n FROM way GROUP BY 1, 2), {SLOPES[len(CELLS) + 2:]}
    SELECT y, x, round(ln(n * 5.0::DOUBLE / tan(radians(greatest(slope, 0.05::DOUBLE)))), 6) AS wetness FROM slopes JOIN drained USING (y, x)""")  # fmt: skip


def roads(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth part starts a straight road; its size tells where to."""
    p, c = table(spark, sf, "part").where("p_partkey % 20 = 0"), F.col
    start = {"east": (c("p_partkey") % 50) * 5.0 + 1, "north": F.floor(c("p_partkey") / 50) * 5.0 + 2}
    return p.withColumns(start).withColumns({"to_east": c("east") + (c("p_size") - 25) * 2, "to_north": c("north") + c("p_size") * 7 % 41 - 20}).select("east", "north", "to_east", "to_north")


add("d32_road_mask", lambda s, d: cells.road_mask(raster(s, d), roads(s, d), 5.0, 4.0),
    f"""WITH {CELLS}, r AS (SELECT p_partkey % 50 * 5.0::DOUBLE + 1 AS e, p_partkey // 50 * 5.0::DOUBLE + 2 AS n, (p_size - 25) * 2.0::DOUBLE AS dx, (p_size * 7 % 41 - 20)::DOUBLE AS dy FROM part WHERE p_partkey % 20 = 0),
    t AS (SELECT y, x, x * 5 + 2.5::DOUBLE - e AS px, y * 5 + 2.5::DOUBLE - n AS py, dx, dy FROM cells, r),
    k AS (SELECT *, coalesce(least(greatest((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0), 0), 1), 0) AS s FROM t),
    hit AS (SELECT DISTINCT y, x FROM k WHERE round(pow(px - s * dx, 2) + pow(py - s * dy, 2), 9) <= 16)
    SELECT c.*, h.y IS NOT NULL AS is_road FROM cells c LEFT JOIN hit h USING (y, x)""")  # fmt: skip
