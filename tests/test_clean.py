"""Golden G4 (two-phase dedupe) and G5 (clean calls), keep-first with a hot key."""
import tempfile

from pyspark.sql import functions as F

from geoseries.operators import clean, geo


def _square(spark):
    df = spark.createDataFrame([(0, 1, "A", [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0},
                                             {"x": 0.0, "y": 10.0}, {"x": 0.0, "y": 0.0}])],
                               "pos int, num int, name string, ring array<struct<x:double,y:double>>")
    return geo.polygons_from_rings(df, "pos", "num", "name", "ring")


POST_SCHEMA = ("file_seq int, block_start long, row_seq long, created_at string, id_str string, text string, "
               "user string, source string, coordinates string")


def test_two_phase_dedupe_g4(spark):
    t = "Wed Oct 10 20:19:24 +0000 2018"
    rows = [(1, 0, 0, t, "x", "a", "u", "Instagram", None), (1, 0, 1, t, "x", "b", "u", "Instagram", "[1.0, 1.0]"),
            (2, 0, 0, t, "x", "c", "u", "Instagram", "[2.0, 2.0]")]
    out = clean.clean_posts(spark.createDataFrame(rows, POST_SCHEMA), _square(spark)).collect()
    assert len(out) == 1 and out[0].text == "c" and out[0].lng == 2.0
    only1 = clean.clean_posts(spark.createDataFrame(rows[:2], POST_SCHEMA), _square(spark)).collect()
    assert only1 == []


def test_twitter_time_parse(spark):
    rows = [(1, 0, 0, "Wed Oct 10 20:19:24 +0200 2018", "x", "a", "u", "Twitter for iPhone", "[1.0, 1.0]")]
    out = clean.clean_posts(spark.createDataFrame(rows, POST_SCHEMA), _square(spark)).first()
    assert str(out.created_at) == "2018-10-10 18:19:24"


CALL_SCHEMA = ("file_seq int, block_start long, row_seq long, call_timestamp string, incident_id string, "
               "officerinitiated string, priority string, calldescription string, category string, "
               "neighborhood string, longitude string, latitude string")


def test_clean_calls_g5(spark):
    base = ["2020-01-01 00:00:00", None, "No", " 2", "d", "ASSAULT", "A", "1.0", "1.0"]
    rows = []
    for i, change in enumerate([{}, {"neighborhood": None}, {"category": "TOW   "}, {"priority": "P "},
                                {"priority": " "}, {"category": None}, {"officerinitiated": "Yes"},
                                {"incident_id": "1,234"}]):
        r = dict(zip(["call_timestamp", "incident_id", "officerinitiated", "priority", "calldescription",
                      "category", "neighborhood", "longitude", "latitude"], base))
        r["incident_id"] = str(100 + i)
        r.update(change)
        rows.append((1, 0, i, r["call_timestamp"], r["incident_id"], r["officerinitiated"], r["priority"],
                     r["calldescription"], r["category"], r["neighborhood"], r["longitude"], r["latitude"]))
    out = clean.clean_calls(spark.createDataFrame(rows, CALL_SCHEMA), _square(spark), []).collect()
    ids = sorted(r.incident_id for r in out)
    assert ids == [100, 105, 106, 1234]
    assert all(r.priority == 2 and r.FID_nhood == "1,A" for r in out)


def test_dedupe_after_filters(spark):
    rows = [(1, 0, 0, "2020-01-01 00:00:00", "7", "No", "P", "d", "X", "A", "1.0", "1.0"),
            (2, 0, 0, "2020-01-01 01:00:00", "7", "No", "3", "d", "X", "A", "1.0", "1.0")]
    out = clean.clean_calls(spark.createDataFrame(rows, CALL_SCHEMA), _square(spark), []).collect()
    assert len(out) == 1 and out[0].priority == 3


def test_keep_first_hot_key(spark):
    # one key holds most rows; keep-first must still pick the earliest (file, row)
    n = 20000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                               (F.lit(n) - F.col("id")).alias("row_seq"), F.lit(1).alias("file_seq"),
                               F.lit(0).cast("long").alias("block_start"), F.col("id").alias("v"))
    out = clean.keep_first(df.repartition(16), ["k"], clean.ORDER_COLS)
    hot = out.where("k = 0").first()
    assert hot.v == max(i for i in range(0, n, 3))
    assert out.count() == df.select("k").distinct().count()


def test_keep_first_null_keys_one_group(spark):
    df = spark.createDataFrame([(None, 1, 0, 0, "a"), (None, 1, 0, 1, "b"), ("k", 1, 0, 2, "c")],
                               "key string, file_seq int, block_start long, row_seq long, v string")
    out = sorted((r.key or "", r.v) for r in clean.keep_first(df, ["key"], clean.ORDER_COLS).collect())
    assert out == [("", "a"), ("k", "c")]


def test_keep_first_never_sorts_whole_rows(spark):
    """Keys and positions are aggregated; whole rows are only probed against the later positions."""
    wide = [f"repeat('x', 20) as c{i}" for i in range(5)]
    df = spark.range(4000).selectExpr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id as string) end as k", *wide,
                                      "1 as file_seq", "0L as block_start", "id as row_seq")
    path = tempfile.mkdtemp(prefix="geoseries-w1-")
    df.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    for limit in (None, 0):
        if limit is not None:
            before, clean.DEFAULT_BROADCAST_LIMIT = clean.DEFAULT_BROADCAST_LIMIT, limit
        out = clean.keep_first(rows, ["k"], clean.ORDER_COLS)
        plan = out._jdf.queryExecution().executedPlan().toString()
        if limit is not None:
            clean.DEFAULT_BROADCAST_LIMIT = before
        assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "Window" not in plan
        assert ("ShuffledHashJoin" if limit == 0 else "BroadcastHashJoin") in plan
        got = {r.k: r.row_seq for r in out.collect()}
        assert out.count() == len(got) == 2 + len([i for i in range(4000) if i % 3 == 2]) and got["hot"] == 0 and got[None] == 1
        assert out.columns == rows.columns
    single = rows.where("k not in ('hot')")
    assert clean.keep_first(single, ["k"], clean.ORDER_COLS).count() == single.count()
