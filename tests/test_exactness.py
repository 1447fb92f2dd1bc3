"""Cases where an approximate method would lose or shift rows."""

import math

from geoseries.operators import geo, series
from geoseries.sources import files


def squares(spark, side, n):
    rows = [(i, i, f"s{i}", [(0.0, i * side), (side, i * side), (side, (i + 1) * side), (0.0, (i + 1) * side), (0.0, i * side)]) for i in range(n)]
    df = spark.createDataFrame(rows, "pos long, num long, name string, ring array<struct<x double, y double>>")
    return geo.polygons_from_rings(df, "pos", "num", "name", "ring")


def test_points_on_cell_bands(spark):
    """Side 0.01: floor(y / cell) and cell * number round differently on many edges."""
    polys = squares(spark, 0.01, 80)
    edges = [r.maxy for r in polys.collect()]
    points = spark.createDataFrame([(i, 0.005, y) for i, y in enumerate(edges)], "id long, lng double, lat double")
    got = geo.label_points(points, polys, "lng", "lat", out_col="k").collect()
    assert len(got) == 80 and not [r for r in got if r.k is None]


def test_radius_across_antimeridian_and_poles(spark):
    points = spark.createDataFrame([(1, 179.9, 0.0), (2, -179.95, 0.1), (3, 0.0, 89.9), (4, 180.0 - 60.0, 89.8), (5, 10.0, 0.0), (6, -179.3, 0.0)], "id long, lng double, lat double")
    centres = spark.createDataFrame([("0.0,-179.9", "60km"), ("89.95,170.0", "60km")], "centre string, radius string")
    got = {(r.id, r.centre) for r in geo.radius_match(points, centres).collect()}

    def far(lat1, lng1, lat2, lng2):
        p, q = math.radians(lat1), math.radians(lat2)
        a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(a))

    want = set()
    for p in points.collect():
        for c in ("0.0,-179.9", "89.95,170.0"):
            lat, lng = map(float, c.split(","))
            if far(p.lat, p.lng, lat, lng) <= 60:
                want.add((p.id, c))
    assert got == want and (1, "0.0,-179.9") in got and (3, "89.95,170.0") in got


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "calls.csv").write_text('incident_id,calldescription,category\n1,"man said ""help, now"" twice",A\n2,"two\nlines",B\n3,plain,C\n')
    rows = {r.incident_id: r for r in files.read_calls_csv(spark, [str(tmp_path / "*.csv")]).collect()}
    assert len(rows) == 3
    assert rows["1"].calldescription == 'man said "help, now" twice' and rows["1"].category == "A"
    assert rows["2"].calldescription == "two\nlines" and rows["3"].category == "C"


def test_joint_rows_with_gaps(spark):
    """Series b has no row in bin 2: its place stays, empty."""
    long = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 10.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 2, 30.0), ("a", 3, 4.0), ("b", 3, 40.0)], "series string, bin int, value double")
    got = {r.row_idx: (r.lags, r.y) for r in series.joint_lag_rows(long, 2).collect()}
    assert got == {0: ([1.0, 10.0, 2.0, None], [3.0, 30.0]), 1: ([2.0, None, 3.0, 30.0], [4.0, 40.0])}


def rings(spark, *all_points):
    rows = [(i, i, f"r{i}", [*map(lambda p: (float(p[0]), float(p[1])), pts), (float(pts[0][0]), float(pts[0][1]))]) for i, pts in enumerate(all_points)]
    df = spark.createDataFrame(rows, "pos long, num long, name string, ring array<struct<x double, y double>>")
    return geo.polygons_from_rings(df, "pos", "num", "name", "ring")


def adjacent(spark, a, b):
    return geo.adjacency(rings(spark, a, b)).count() == 2


def test_overlap_is_not_adjacency(spark):
    """Rings that overlap though no vertex or whole-edge midpoint lies inside the other."""
    assert not adjacent(spark, [(0, -3), (4, -3), (4, 3), (4, 5), (0, 5), (0, 1)], [(0, 0), (16, 12), (16, 13), (4, 3.5), (-20, -11.5)])
    unit = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert not adjacent(spark, unit, [(0, 0), (0.5, 0), (1, 0), (1, 1), (0, 1)])      # the same region
    assert not adjacent(spark, unit, [(0.2, 0), (0.8, 0), (0.8, 0.5), (0.2, 0.5)])    # inside, sharing an edge
    assert not adjacent(spark, unit, [(5, 5), (6, 5), (6, 6), (5, 6)])
    assert adjacent(spark, unit, [(1, 0.3), (2, 0.3), (2, 0.7), (1, 0.7)])            # part of an edge
    assert adjacent(spark, unit, [(1, 1), (2, 1), (2, 2), (1, 2)])                    # a corner
    assert adjacent(spark, unit, [(1 / 3, 1), (2 / 3, 1), (0.5, 1.7)])
    assert adjacent(spark, [(0, 0), (3, 1), (0, 1)], [(0, 0), (3, 1), (3, 0)])        # a slanted edge
    assert adjacent(spark, [(0, 0), (3, 1), (0, 1)], [(1.5, 0.5), (3, 1), (3, 0)])    # half of it
