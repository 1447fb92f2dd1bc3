"""Golden G2 (point in polygon), G3 (adjacency), G6 (relabel)."""
from pyspark.sql import functions as F

from geoseries.operators import geo


def _polys(spark, squares):
    rows = []
    for pos, (num, name, x0, y0, x1, y1) in enumerate(squares):
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        rows.append((pos, num, name, [{"x": float(x), "y": float(y)} for x, y in ring]))
    df = spark.createDataFrame(rows, "pos int, num int, name string, ring array<struct<x:double,y:double>>")
    return geo.polygons_from_rings(df, "pos", "num", "name", "ring")


def test_point_in_polygon_g2(spark):
    polys = _polys(spark, [(1, "A", 0, 0, 2, 2), (2, "B", 2, 0, 4, 2)])
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 4.0, 2.0), (4, 3.0, 0.0),
                                 (5, 5.0, 5.0), (6, None, None)], "id int, x double, y double")
    got = {r.id: r.k for r in geo.label_points(pts, polys, "x", "y", "k").collect()}
    assert got == {1: "1,A", 2: "1,A", 3: "2,B", 4: "2,B", 5: None, 6: None}


def test_point_in_polygon_invariant_to_row_order(spark):
    a = _polys(spark, [(1, "A", 0, 0, 2, 2), (2, "B", 2, 0, 4, 2)])
    b = a.orderBy(F.desc("file_pos"))
    pts = spark.createDataFrame([(i, i * 0.25, 1.0) for i in range(17)], "id int, x double, y double")
    ga = sorted(geo.label_points(pts, a, "x", "y", "k").select("id", "k").collect())
    gb = sorted(geo.label_points(pts, b, "x", "y", "k").select("id", "k").collect())
    assert ga == gb


def test_adjacency_g3(spark):
    polys = _polys(spark, [(1, "A", 0, 0, 2, 2), (2, "B", 2, 0, 4, 2), (3, "C", 0, 2, 4, 4),
                           (4, "D", 4, 4, 5, 5), (5, "E", 1, 1, 3, 3)])
    pairs = {(r.centre, r.neighbour) for r in geo.adjacency(polys).collect()}
    adj = {}
    for c, n in pairs:
        adj.setdefault(c, set()).add(n)
    assert adj["1,A"] == {"2,B", "3,C"}
    assert adj["2,B"] == {"1,A", "3,C"}
    assert adj["3,C"] == {"1,A", "2,B", "4,D"}
    assert adj["4,D"] == {"3,C"}
    assert "5,E" not in adj
    assert all((n, c) in pairs for c, n in pairs)          # symmetric
    assert all(c != n for c, n in pairs)                   # irreflexive


def test_relabel_g6(spark):
    polys = _polys(spark, [(7, "Twin", 0, 0, 2, 2), (3, "Solo", 2, 0, 4, 2),
                           (9, "Twin", 4, 0, 6, 2)])
    rows = spark.createDataFrame([(1, "Solo", 50.0, 50.0), (2, "Twin", 5.0, 1.0),
                                  (3, "Twin", 50.0, 50.0)], "id int, neighborhood string, lng double, lat double")
    got = {r.id: r.FID_nhood for r in geo.relabel(rows, polys, ["Twin"], lng_col="lng", lat_col="lat").collect()}
    assert got == {1: "3,Solo", 2: "9,Twin", 3: None}


def test_relabel_unknown_name(spark):
    polys = _polys(spark, [(1, "A", 0, 0, 2, 2)])
    rows = spark.createDataFrame([(1, "Nowhere", 1.0, 1.0)], "id int, neighborhood string, lng double, lat double")
    got = geo.relabel(rows, polys, [], lng_col="lng", lat_col="lat", on_unknown="null").collect()
    assert got[0].FID_nhood is None
    try:
        geo.relabel(rows, polys, [], lng_col="lng", lat_col="lat", on_unknown="error").collect()
        raise AssertionError("expected an error")
    except Exception as ex:  # noqa: BLE001
        assert "unknown neighbourhood" in str(ex)


def test_polygon_duplicate_key_later_ring_first_position(spark):
    df = spark.createDataFrame([
        (0, 7, "X", "[[[0,0],[1,0],[1,1],[0,0]]]"), (1, 8, "Y", "[[[5,5],[6,5],[6,6],[5,5]]]"),
        (2, 7, "X", "[[[2,2],[3,2],[3,3],[2,2]]]")], "pos int, n int, name string, c string")
    p = {r.key: r for r in geo.polygons_from_table(df, "n", "name", "c", "pos").collect()}
    assert p["7,X"].file_pos == 0 and p["7,X"].minx == 2.0


def test_radius_match_multiple_centres(spark):
    pts = spark.createDataFrame([(1, -83.05, 42.33), (2, -80.0, 40.0)], "id int, lng double, lat double")
    centres = spark.createDataFrame([("42.33,-83.05", "1mi"), ("42.335,-83.05", "1km")], "centre string, radius string")
    got = sorted((r.id, r.centre) for r in geo.radius_match(pts, centres).collect())
    assert got == [(1, "42.33,-83.05"), (1, "42.335,-83.05")]
