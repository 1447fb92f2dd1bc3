"""SURVEY §2.11 semantics: blank names, non-Polygon geometry, horizontal edges,
shared vertices, key splitting, number parsing, local time, frequencies."""
import pytest
from pyspark.sql import functions as F

from geoseries.functions import text
from geoseries.operators import bins, clean, geo


def _polys(spark, squares):
    rows = []
    for pos, (num, name, x0, y0, x1, y1) in enumerate(squares):
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        rows.append((pos, num, name, [{"x": float(x), "y": float(y)} for x, y in ring]))
    df = spark.createDataFrame(rows, "pos int, num int, name string, ring array<struct<x:double,y:double>>")
    return geo.polygons_from_rings(df, "pos", "num", "name", "ring")


def test_blank_name_survives_null_test_then_is_unknown(spark):
    rows = [(1, 0, 0, "2020-01-01 00:00:00", "1", "No", "1", "d", "X", "  ", "1.0", "1.0")]
    schema = ("file_seq int, block_start long, row_seq long, call_timestamp string, incident_id string, "
              "officerinitiated string, priority string, calldescription string, category string, "
              "neighborhood string, longitude string, latitude string")
    raw = spark.createDataFrame(rows, schema)
    with pytest.raises(Exception, match="unknown neighbourhood"):
        clean.clean_calls(raw, _polys(spark, [(1, "A", 0, 0, 2, 2)]), []).collect()
    assert clean.clean_calls(raw, _polys(spark, [(1, "A", 0, 0, 2, 2)]), [], on_unknown="null").count() == 0


def test_multipolygon_is_rejected(spark):
    df = spark.createDataFrame([(0, 1, "M", "MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]]]"),
                                (1, 2, "P", "Polygon", "[[[0,0],[4,0],[4,4],[0,4],[0,0]]]")],
                               "pos int, n int, name string, t string, c string")
    p = geo.polygons_from_table(df, "n", "name", "c", "pos", "t")
    valid = {r.key: r.valid for r in p.collect()}
    assert valid == {"1,M": False, "2,P": True}
    pts = spark.createDataFrame([(1, 0.5, 0.2)], "id int, x double, y double")
    assert geo.label_points(pts, p, "x", "y", "k").first().k == "2,P"


def test_horizontal_edges_and_shared_vertex(spark):
    p = _polys(spark, [(1, "A", 0, 0, 2, 2), (2, "B", 2, 0, 4, 2), (3, "C", 0, 2, 2, 4), (4, "D", 2, 2, 4, 4)])
    pts = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0), (3, 3.0, 4.0), (4, 5.0, 2.0), (5, 3.0, 0.0)],
                                "id int, x double, y double")
    got = {r.id: r.k for r in geo.label_points(pts, p, "x", "y", "k").collect()}
    assert got == {1: "1,A", 2: "1,A", 3: "4,D", 4: None, 5: "2,B"}


def test_key_split_and_numbers(spark):
    df = spark.createDataFrame([("12,Oak, Grove", "1,234,567", "x12")], "k string, n string, bad string")
    r = df.select(text.key_fid("k").alias("fid"), text.key_name("k").alias("name"),
                  text.parse_number("n").alias("n"), text.parse_number("bad").alias("bad")).first()
    assert (r.fid, r.name, r.n, r.bad) == (12, "Oak", 1234567, None)


def test_epoch_ms_to_eastern_local_time(spark):
    df = spark.createDataFrame([(1704067200000,), (1719835200000,)], "ms long")   # Jan 1 / Jul 1 2024 UTC
    got = [str(r.t) for r in df.select(text.epoch_ms_to_local("ms").alias("t")).collect()]
    assert got == ["2023-12-31 19:00:00", "2024-07-01 08:00:00"]


def test_frequencies():
    assert bins.freq_seconds("180Min") == bins.freq_seconds("3H") == 10800
    assert bins.freq_seconds("1D") == 86400 and bins.freq_seconds(300) == 300
    with pytest.raises(ValueError):
        bins.freq_seconds("3 fortnights")


def test_strip_matches_python(spark):
    s = "　\t x y \x85\n"
    assert spark.range(1).select(text.strip_ws(F.lit(s)).alias("v")).first().v == s.strip()


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("TOW",), (None,), ("X",)], "category string")
    assert sorted(r.category or "" for r in df.where(clean.not_in_keep_null("category", ["TOW"])).collect()) == ["", "X"]
