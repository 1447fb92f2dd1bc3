"""End-to-end flows on files derived from the sf0.001 tables."""
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from geoseries.operators import mapframe
from geoseries.plans import catalogue as C
from geoseries.plans import flows
from geoseries.plans import standins as S


def test_calls_to_attention_from_files(spark):
    d = tempfile.mkdtemp(prefix="geoseries-flow-")
    raw = S.calls_raw(spark, SF_SMALL)
    cols = [c for c in raw.columns if c not in ("file_seq", "block_start", "row_seq")]
    for seq in (1, 2):
        (raw.where(F.col("file_seq") == seq).orderBy("row_seq").select(*cols).coalesce(1).write
            .option("header", True).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(f"{d}/in/calls_{2018 + seq}"))
    S.neighbourhood_table(spark, SF_SMALL).coalesce(1).write.option("header", True).csv(f"{d}/in/nhoods")
    got = flows.calls_to_attention(spark, [f"{d}/in/calls_2019/*.csv", f"{d}/in/calls_2020/*.csv"],
                                   f"{d}/in/nhoods", f"{d}/out", C.RELABEL_NAMES, "3H")
    want = C.q_attention_level(spark, SF_SMALL)
    key = ["bin", "FID_nhood"]
    a = {tuple(r[k] for k in key): round(r.att_level, 6) for r in got.collect()}
    b = {tuple(r[k] for k in key): r.att_level for r in want.collect()}
    assert a == b


def test_forecast_table_feeds_the_map(spark):
    long = C.series_long(spark, SF_SMALL)
    wide = flows.forecast_table(long, "3H", fh=8, season=8, p_range=(1, 3), d_range=(0, 2))
    assert wide.count() == 8
    day = wide.select("Day").first().Day
    renamed = wide.select(*[F.col(c).alias(f"{i},{c}") for i, c in enumerate(wide.columns[:-2])], "Day", "Hour")
    frame = mapframe.day_map_frame(renamed, day, S.polygons(spark, SF_SMALL), value="att_level")
    assert frame.count() > 0 and frame.where("zmin <= att_level AND att_level <= zmax").count() == frame.count()


def test_statuses_to_tables(spark):
    d = tempfile.mkdtemp(prefix="geoseries-flow-st-")
    docs = S.status_docs(spark, SF_SMALL).select("value")
    docs.repartition(3).write.text(f"{d}/landing")
    t = flows.statuses_to_tables(spark, f"{d}/landing", f"{d}/out", box=(0.0, 0.0, 10.0, 10.0), query_geo="g")
    from geoseries.sources import statuses as stat
    parsed = stat.parse_statuses(docs)
    lng = F.col("coordinates.coordinates")[0]
    lat = F.col("coordinates.coordinates")[1]
    inside = parsed.where(lng.between(0.0, 10.0) & lat.between(0.0, 10.0))
    assert t["tweet"].count() == inside.count()
    assert t["user"].count() == inside.where(F.col("user").isNotNull()).count()
    assert t["place"].count() == inside.where(F.col("place").isNotNull()).count()


def test_landed_statuses_to_working_series(spark):
    """Entry B to its end: statuses land twice in several batches, and the working
    series counts each post once."""
    from geoseries.operators import bins, clean, geo
    from geoseries.sources import files
    d = tempfile.mkdtemp(prefix="geoseries-flow-b-")
    docs = S.status_docs(spark, SF_SMALL).select("value")
    docs.repartition(2).write.text(f"{d}/landing")
    flows.statuses_to_tables(spark, f"{d}/landing", f"{d}/out", box=(0.0, 0.0, 10.0, 10.0))
    docs.repartition(2).write.mode("append").text(f"{d}/landing")
    flows.statuses_to_tables(spark, f"{d}/landing", f"{d}/out", box=(0.0, 0.0, 10.0, 10.0))
    landed = files.read_landed_posts(spark, f"{d}/out/tables/tweet")
    assert landed.select("file_seq").distinct().count() == 2
    assert landed.count() == 2 * landed.select("id_str").distinct().count()
    polys, calls = S.polygons(spark, SF_SMALL), clean.clean_calls(S.calls_raw(spark, SF_SMALL), S.polygons(spark, SF_SMALL), [])
    out = flows.landed_to_working_series(spark, f"{d}/out/tables", calls, polys, f"{d}/clean").cache()
    posts = clean.clean_posts(landed.where("file_seq = 0"), polys)
    one = bins.working_series({"calls": (calls, "call_timestamp", "incident_id"), "tweets": (posts, "created_at", "id_str"),
                               "users": (posts, "created_at", "user")}, geo.adjacency(polys))
    assert out.count() == one.count() and out.exceptAll(one.select(out.columns)).count() == 0
    assert out.agg(F.sum("tweets")).first()[0] == posts.count() > 0


def test_strict_flow_raises_and_lenient_flow_sets_aside(spark):
    d = tempfile.mkdtemp(prefix="geoseries-flow-strict-")
    raw = S.calls_dirty(spark, SF_SMALL)
    cols = [c for c in raw.columns if c not in ("file_seq", "block_start", "row_seq")]
    raw.where("file_seq = 1").orderBy("row_seq").select(cols).coalesce(1).write.option("header", True).csv(f"{d}/calls")
    S.neighbourhood_table(spark, SF_SMALL).coalesce(1).write.option("header", True).csv(f"{d}/nhoods")
    args = (spark, [f"{d}/calls/*.csv"], f"{d}/nhoods")
    level = flows.calls_to_attention(*args, f"{d}/out")
    assert level.count() > 0 and spark.read.parquet(f"{d}/out/calls_rejected").count() > 0
    import pytest
    with pytest.raises(Exception, match="refused cast in file"):
        flows.calls_to_attention(*args, f"{d}/out2", strict=True)


def test_a_feed_lands_in_small_compressed_files_and_its_replay_after_it(spark, tmp_path, monkeypatch):
    spark.range(95).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 5 as user_id", "'view' as event_type",
                               "1.0D as value", "concat('line', char(10), 'two') as props").coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(25).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1, 5).selectExpr("id as c_custkey", "'n' as c_name", "'m' as c_mktsegment", "1.5D as c_acctbal",
                                 "cast(id as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(C, "LANDED_ROWS", 10)
    base = C._land_statuses(spark, str(tmp_path))
    landed = spark.read.text(f"{base}/landing")
    per_file = landed.groupBy(F.input_file_name().alias("f")).count().collect()
    assert all(r.f.endswith(".gz") and r["count"] <= 10 for r in per_file) and len(per_file) >= 20
    docs = S.status_docs(spark, str(tmp_path)).select("value")
    twice = docs.unionAll(docs)
    assert landed.exceptAll(twice).count() == 0 and twice.exceptAll(landed).count() == 0
    from geoseries.streaming import statuses as st
    st.run_entity_sink(C._stream_statuses(spark, base), f"{base}/out", f"{base}/ck", "2024-02-01 00:00:00", "g").awaitTermination()
    tweets = spark.read.parquet(f"{base}/out/tweet")
    assert tweets.select("batch_id").distinct().count() == C.LANDED_BATCHES
    assert tweets.count() == 2 * tweets.select("id_str").distinct().count() > 0


def test_a_query_that_counts_windows_reads_only_what_it_counts(spark, tmp_path, monkeypatch):
    """Point, id and time of a whole status are read, and the point is looked up behind the de-duplication."""
    spark.range(60).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 5 as user_id", "'view' as event_type",
                               "1.0D as value", "'p' as props").coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(25).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1, 5).selectExpr("id as c_custkey", "'n' as c_name", "'m' as c_mktsegment", "1.5D as c_acctbal",
                                 "cast(id as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    from geoseries.streaming import statuses as st
    seen, label, parse = [], st.label_points, st.parse_statuses
    monkeypatch.setattr(st, "label_points", lambda df, *a, **k: seen.append(df._jdf.queryExecution().analyzed().toString()) or label(df, *a, **k))
    monkeypatch.setattr(st, "parse_statuses", lambda df, *a, **k: seen.append(parse(df, *a, **k)) or seen[-1])
    n = {name: C.QUERIES[name](spark, str(tmp_path)).agg(F.sum("n")).first()[0] for name in ("stream_bin_nhood", "stream_bin_once")}
    narrow, plan, narrow_too = seen
    assert narrow.columns == narrow_too.columns == ["created_at", "id_str", "coordinates"]
    assert "DeduplicateWithinWatermark" in plan
    assert n["stream_bin_nhood"] == n["stream_bin_once"] > 0
