"""Hot keys: a third of all rows in one key / cell / bin must give the same
answers as the even case, and the shuffle fallback of the polygon join must
equal the broadcast plan."""
from pyspark.sql import functions as F

from geoseries.operators import bins, geo


def _grid_polys(spark, n=4):
    rows = []
    for k in range(n * n):
        x0, y0 = (k % n) * 2.0, (k // n) * 2.0
        ring = [(x0, y0), (x0 + 2, y0), (x0 + 2, y0 + 2), (x0, y0 + 2), (x0, y0)]
        rows.append((k, k, f"N{k}", [{"x": x, "y": y} for x, y in ring]))
    df = spark.createDataFrame(rows, "pos int, num int, name string, ring array<struct<x:double,y:double>>")
    return geo.polygons_from_rings(df, "pos", "num", "name", "ring")


def _points(spark, n=30000):
    # every third point sits in one hot spot
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(1.25)).otherwise((F.col("id") * 7 % 800) / 100.0).alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit(1.75)).otherwise((F.col("id") * 13 % 800) / 100.0).alias("y"))


def test_shuffle_fallback_equals_broadcast(spark):
    polys, pts = _grid_polys(spark), _points(spark)
    a = sorted(geo.label_points(pts, polys, "x", "y", "k").select("id", "k").collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = geo.label_points(pts, polys, "x", "y", "k", broadcast_limit=0)
        rows = sorted(b.select("id", "k").collect())
        assert "SortMergeJoin" in b._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert a == rows
    assert sum(1 for r in a if r.k == "0,N0") >= 10000


def test_hot_bin_counts(spark):
    n = 30000
    df = spark.range(n).select(
        F.col("id").alias("incident_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), (F.col("id") % 7).cast("string")))
        .alias("FID_nhood"),
        F.when(F.col("id") % 3 == 0, F.expr("TIMESTAMP_NTZ'2024-01-01 01:00:00'"))
        .otherwise(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(mins=(F.col("id") % 600).cast("int")))
        .alias("call_timestamp"),
        (F.col("id") % 5 + 1).alias("priority"))
    out = bins.time_groupby(df, "incident_id", "count", "all", "3H")
    assert out.agg(F.sum("value")).first()[0] == n
    hot = out.where("FID_nhood = 'hot'").agg(F.max("value")).first()[0]
    assert hot == n // 3


def test_one_huge_polygon_does_not_explode_cells(spark):
    rows = [(0, 0, "BIG", [{"x": 0.0, "y": 0.0}, {"x": 10000.0, "y": 0.0}, {"x": 10000.0, "y": 10000.0},
                           {"x": 0.0, "y": 10000.0}, {"x": 0.0, "y": 0.0}])]
    for k in range(1, 50):
        x0 = float(k)
        rows.append((k, k, f"S{k}", [{"x": x0, "y": 0.0}, {"x": x0 + 1, "y": 0.0}, {"x": x0 + 1, "y": 1.0},
                                     {"x": x0, "y": 1.0}, {"x": x0, "y": 0.0}]))
    df = spark.createDataFrame(rows, "pos int, num int, name string, ring array<struct<x:double,y:double>>")
    polys = geo.polygons_from_rings(df, "pos", "num", "name", "ring")
    st = geo.polygon_stats(polys)
    assert set(st["levels"].values()) == {0, 14}   # sides 1 and 10000
    big = polys.where("key = '0,BIG'")
    assert geo.candidate_cells(big, 14).count() == 1
    pts = spark.createDataFrame([(1, 5000.0, 5000.0), (2, 3.5, 0.5)], "id int, x double, y double")
    got = {r.id: r.k for r in geo.label_points(pts, polys, "x", "y", "k").collect()}
    assert got == {1: "0,BIG", 2: "0,BIG"}


def _square(k, x0, y0, side):
    return (k, k, f"P{k}", [{"x": x, "y": y} for x, y in [(x0, y0), (x0 + side, y0), (x0 + side, y0 + side), (x0, y0 + side), (x0, y0)]])


RINGS = "pos int, num int, name string, ring array<struct<x:double,y:double>>"


def test_an_outline_leaves_the_cells_of_the_blocks_alone(spark):
    """One city outline of many edges and 10,000 blocks: at most four block
    candidates in any cell of theirs, and a bounded number of edges in the outline's."""
    import math
    blocks = [_square(k, float(k % 100), float(k // 100), 1.0) for k in range(10_000)]
    angle = [2 * math.pi * i / 4000 for i in range(4000)]
    ring = [{"x": 50 + 80 * math.cos(a), "y": 50 + 80 * math.sin(a)} for a in angle]
    outline = (20_000, 20_000, "CITY", [*ring, ring[0]])
    polys = geo.polygons_from_rings(spark.createDataFrame([*blocks, outline], RINGS), "pos", "num", "name", "ring").cache()
    st = geo.polygon_stats(polys)
    levels = sorted(set(st["levels"].values()))
    assert levels[0] == 0 and len(levels) == 2
    cells = geo.candidate_cells(polys.where("file_pos < 20000"), 0)
    assert cells.agg(F.max(F.size("_cands"))).first()[0] <= 4
    wide = geo.candidate_cells(polys.where("file_pos = 20000"), levels[1])
    assert wide.count() <= (geo.MAX_CUTS + 2) ** 2
    assert wide.agg(F.max(F.expr("size(_cands[0].edges)"))).first()[0] <= 1000
    pts = spark.createDataFrame([(1, 3.5, 7.25), (2, -20.0, 50.0), (3, 129.9, 50.0), (4, 140.0, 50.0), (5, 100.0, 100.0), (6, None, 1.0)], "id int, x double, y double")
    got = {r.id: r.k for r in geo.label_points(pts, polys, "x", "y", "k", stats=st).collect()}
    assert got == {1: "703,P703", 2: "20000,CITY", 3: "20000,CITY", 4: None, 5: "9999,P9999", 6: None}
    # beyond the broadcast limit the blocks' level is shuffled, the answer the same
    again = geo.label_points(pts, polys, "x", "y", "k", stats=st, broadcast_limit=st["level_bytes"][levels[1]])
    assert {r.id: r.k for r in again.collect()} == got


def test_polygons_of_very_many_sizes(spark):
    """More size classes than levels that are probed: classes merge, answers stay."""
    rows = [_square(k, 0.0, 0.0, 2.0 ** (12 - k)) for k in range(24)]
    polys = geo.polygons_from_rings(spark.createDataFrame(rows, RINGS), "pos", "num", "name", "ring")
    st = geo.polygon_stats(polys)
    assert len(set(st["levels"].values())) <= geo.MAX_LEVELS < len(st["levels"])
    pts = spark.createDataFrame([(1, 4000.0, 1.0), (2, 4097.0, 1.0)], "id int, x double, y double")
    assert {r.id: r.k for r in geo.label_points(pts, polys, "x", "y", "k").collect()} == {1: "0,P0", 2: None}
    # boxes of all sizes meet in one corner, each pair once
    pairs = geo.box_pairs(polys.where("valid"), st)
    assert pairs.count() == pairs.distinct().count() == 24 * 23 // 2


def test_one_wide_circle_leaves_the_others_cells_alone(spark):
    """A circle of 500 km beside 10,000 of 1 km: the small ones keep their few cells."""
    small = spark.range(10_000).selectExpr("concat(cast(40 + (id % 100) * 0.05 as string), ',', cast(-80 + floor(id / 100) * 0.05 as string)) as centre", "'1km' as radius")
    wide = spark.createDataFrame([("42.5,-77.5", "500km")], "centre string, radius string")
    points = spark.createDataFrame([(1, -79.999, 40.001), (2, -77.5, 42.5), (3, -70.0, 42.5)], "id int, lng double, lat double")
    both = geo.radius_match(points, small.unionByName(wide)).groupBy("id", "radius").count().collect()
    alone = geo.radius_match(points, small).groupBy("id", "radius").count().collect()
    assert sorted(r for r in both if r.radius == "1km") == sorted(alone) and {r.id for r in both if r.radius == "500km"} == {2} | {1}
    assert geo.merge_levels(range(30)) == {i: min(29, i // 4 * 4 + 3) for i in range(30)}
