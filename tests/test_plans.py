"""Physical-plan checks: no Python evaluation anywhere, broadcast polygon lookup,
filter pushdown and column pruning at the Parquet scan."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from geoseries.operators import bins, clean, geo, series
from geoseries.plans import standins as S
from geoseries.plans.catalogue import QUERIES

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas",
            "PythonMapInArrow")
SKIP = {"rf_grid"}  # fits models in a driver loop; covered in test_forecast


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SKIP and not n.startswith("stream_")])
def test_no_python_evaluation_no_cross_join(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()       # final adaptive plan
    plan = _plan(df)
    assert not any(p in plan for p in PY_NODES), name
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_polygon_lookup_is_broadcast(spark):
    pts = S.table(spark, SF_SMALL, "events").select("event_id", (F.col("value") / 50).alias("x"),
                                                    (F.col("user_id") / 15.0).alias("y"))
    plan = _plan(geo.label_points(pts, S.polygons(spark, SF_SMALL), "x", "y", "k"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_time_filter_pushed_to_scan(spark):
    ev = S.table(spark, SF_SMALL, "events")
    df = clean.time_range(ev, "ts", "2024-01-10 00:00:00", "2024-01-17 00:00:00").select("event_id")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_call_standin_prunes_columns(spark):
    plan = _plan(S.calls_raw(spark, SF_SMALL).select("incident_id"))
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_decomposition_shuffles_once(spark):
    """Phase means use the series' own partitions: one exchange, the rest are sorts within them."""
    x = spark.range(1000).selectExpr("cast(id % 3 as string) series", "id bin", "cast(id as double) value")
    assert _plan(series.decompose(x, 8)).count("Exchange") == 1


def test_working_series_reads_each_count_table_twice(spark):
    """Counts and empty bins of a source meet all centres in one join."""
    rows = spark.range(300).selectExpr("concat('n', id % 4) as FID_nhood", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id % 50 as int)) as t", "id as k")
    pairs = spark.createDataFrame([("n0", "n1"), ("n1", "n0"), ("n2", "n3"), ("n3", "n2")], "centre string, neighbour string")
    out = bins.working_series({"x": (rows, "t", "k")}, pairs, "3H")
    assert _plan(out).count("BroadcastHashJoin") == 1
    total = out.agg(F.sum("x"), F.sum("x_adj")).first()
    assert tuple(total) == (300, 300)


def test_page_records_never_meet_in_one_task(spark, tmp_path):
    """The last page's number is taken of the numbers alone; a window over all pages
    would bring every record into one task."""
    spark.range(1201).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 5 as user_id", "'view' as event_type",
                                 "1.0D as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(25).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(21).selectExpr("id as s_suppkey", "cast(id % 3 as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for pages, flag in ((S.call_pages(spark, str(tmp_path)), "$.exceededTransferLimit"),
                        (S.boundary_pages(spark, str(tmp_path)), "$.properties.exceededTransferLimit")):
        plan = _plan(pages)
        assert "Window" not in plan and "SinglePartition" not in plan.split("Subquery")[0]
        more = {r.page_no: r.more for r in pages.select("page_no", F.get_json_object("text", flag).alias("more")).collect()}
        assert more == {1: "true", 2: "true", 3: None}


def test_a_status_is_parsed_once_and_a_point_located_once(spark, tmp_path):
    """A filter on what a row's parse or locating gives does not run it again."""
    from geoseries.sources.statuses import parse_statuses
    from geoseries.streaming.statuses import in_box

    def optimized(df):
        return df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([('{"id_str": "1", "coordinates": {"coordinates": [1.0, 2.0]}}',), ("{broken",), (None,)], "value string")
    docs.write.text(str(tmp_path / "landing"))
    parsed = parse_statuses(spark.read.text(str(tmp_path / "landing")))
    assert optimized(in_box(parsed, (0.0, 0.0, 10.0, 10.0))).count("from_json") == 1
    assert parse_statuses(docs).count() == 3 and parse_statuses(docs).where("id_str is null").count() == 2
    square = spark.createDataFrame([(0, 1, "A", [(0.0, 0.0), (6.0, 0.0), (6.0, 10.0), (0.0, 10.0), (0.0, 0.0)])],
                                   "pos long, num int, name string, ring array<struct<x double, y double>>")
    polys = geo.polygons_from_rings(square, "pos", "num", "name", "ring")
    pts = spark.createDataFrame([(1.0, 1.0), (6.0, 3.0), (7.0, 3.0), (None, 3.0)], "x double, y double")
    found = geo.label_points(pts, polys, "x", "y", "k")
    assert optimized(found.where("k is not null")).count("aggregate(") == 1
    assert sorted((str(r.x), r.k) for r in found.collect()) == [("1.0", "1,A"), ("6.0", "1,A"), ("7.0", None), ("None", None)]
