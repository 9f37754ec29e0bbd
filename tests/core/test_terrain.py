"""Hollows, routing and roads, against plain floods and constructed rasters."""

import heapq
import random

import pytest

from sluice.operators import cells, depressions
from sluice.session import written

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def flooded(z):
    """Spill levels by one flood over the whole raster."""
    heap = [(h, p) for p, h in z.items() if any((p[0] + a, p[1] + b) not in z for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
    heapq.heapify(heap)
    level = {}
    while heap:
        low, p = heapq.heappop(heap)
        if p not in level:
            level[p] = low
            for a, b in AROUND:
                q = (p[0] + a, p[1] + b)
                if q in z and q not in level:
                    heapq.heappush(heap, (max(low, z[q]), q))
    return level


def frame(spark, z):
    return spark.createDataFrame([(y, x, h) for (y, x), h in z.items()], "y long, x long, z double")


def ragged():
    rng = random.Random(1)
    return {(y, x): float(rng.randrange(30)) for y in range(-7, 17) for x in range(-5, 19) if rng.random() > 0.01}


@pytest.mark.parametrize(("tile", "small"), [(50, 200_000), (4, 400)])
def test_filled_equals_one_flood_whatever_the_tiles(spark, tile, small):
    z = ragged()
    want = flooded(z)
    assert sum(want[p] > z[p] for p in z) > 50
    assert {(r.y, r.x): r.filled for r in depressions.filled(frame(spark, z), tile, small).collect()} == want


def test_filled_of_no_cells_nulls_and_one_cell(spark):
    none = spark.createDataFrame([], "y long, x long, z double")
    assert depressions.filled(none).count() == 0
    some = spark.createDataFrame([(0, 0, 3.0), (0, 1, None), (5, 5, float("nan"))], "y long, x long, z double")
    assert [tuple(r) for r in depressions.filled(some).collect()] == [(0, 0, 3.0)]


def bowl():
    """A plane that falls towards x = 0 with a bowl of 0.4 at (10, 12)."""
    z = {}
    for y in range(21):
        for x in range(25):
            away = ((y - 10) ** 2 + (x - 12) ** 2) ** 0.5
            z[y, x] = 10 + 0.01 * x - max(0.0, 0.4 * (1 - away / 5))
    return z


def test_bowl_in_a_plane(spark):
    z = bowl()
    hollow = written(depressions.hollows(frame(spark, z), tile=8), "test")
    depth = {(r.y, r.x): r.depth for r in hollow.collect()}
    assert 0.3 < depth[10, 12] < 0.4
    assert depth[2, 2] == 0.0
    # the dent leads water inwards: what runs through the bottom is more than any cell of the open plane beside it gets
    surface = depressions.routing_surface(hollow)
    to = {(r.y, r.x): (r.to_y, r.to_x) for r in cells.receivers(surface, 1.0).collect()}
    assert to[10, 12] == (None, None)
    drained = cells.accumulation(written(cells.receivers(surface, 1.0), "test"), lambda df: written(df, "test"))
    through = {(r.y, r.x): r.cells for r in drained.collect()}
    assert through[10, 12] > 40
    sloped = cells.slopes(frame(spark, z), 1.0)
    wetness = {(r.y, r.x): r.wetness for r in depressions.wetness(sloped, drained, 1.0).collect()}
    assert wetness[10, 12] > max(wetness[3, x] for x in range(5, 20))


def test_roads_are_cells_near_a_line(spark):
    rng = random.Random(4)
    z = {(y, x): 0.0 for y in range(20) for x in range(20)}
    pieces = [tuple(rng.uniform(-20, 120) for _ in range(4)) for _ in range(12)] + [(10.0, 10.0, 10.0, 10.0), (0.0, 50.0, 100.0, 50.0), (50.0, 0.0, 50.0, 100.0)]
    roads = spark.createDataFrame([*pieces, (None, 1.0, 2.0, 3.0)], "east double, north double, to_east double, to_north double")

    def near(y, x, piece, reach):
        e, n, te, tn = piece
        px, py, dx, dy = (x + 0.5) * 5 - e, (y + 0.5) * 5 - n, te - e, tn - n
        t = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return round((px - t * dx) ** 2 + (py - t * dy) ** 2, 9) <= reach * reach

    for reach in (1.0, 8.0):
        want = {p for p in z if any(near(*p, piece, reach) for piece in pieces)}
        got = cells.road_mask(frame(spark, z), roads, 5.0, reach).collect()
        assert len(got) == 400
        assert {(r.y, r.x) for r in got if r.is_road} == want
