"""Streaming (availableNow) equals the batch twin; replayed batches do not duplicate."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from geoseries.operators import geo
from geoseries.plans import standins as S
from geoseries.sources import statuses as stat
from geoseries.streaming import statuses as st

from conftest import SF_SMALL


def _doc(i, lng, lat, user=True, place=False):
    d = {"created_at": f"Wed Jan 0{1 + i % 3} 0{i % 10}:00:00 +0000 2024", "id_str": str(i), "text": f"t{i}",
         "source": "Instagram", "truncated": False, "is_quote_status": False, "retweet_count": 0,
         "favorite_count": 0, "favorited": False, "retweeted": False, "lang": "en",
         "coordinates": {"coordinates": [lng, lat], "type": "Point"}}
    if user:
        d["user"] = {"id_str": f"u{i % 4}", "name": "n", "followers_count": i}
    if place:
        d["place"] = {"id": "p", "name": "x", "bounding_box": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}}
    return json.dumps(d)


def _land(docs_per_file):
    base = tempfile.mkdtemp(prefix="geoseries-stream-test-")
    land = os.path.join(base, "landing")
    os.makedirs(land)
    for k, docs in enumerate(docs_per_file):
        with open(os.path.join(land, f"part-{k:03d}.json"), "w") as f:
            f.write("\n".join(docs) + "\n")
    return base, land


def test_stream_equals_batch(spark):
    docs = [_doc(i, 1.0 + i % 5, 2.0, user=i % 3 != 0, place=i % 4 == 0) for i in range(40)]
    docs.append(_doc(99, 50.0, 50.0))  # outside the box
    base, land = _land([docs[:20], docs[20:], docs[:10]])  # last file replays ten statuses
    stream = st.in_box(st.status_stream(spark, land, max_files=1), (0.0, 0.0, 10.0, 10.0))
    q = st.run_entity_sink(stream, f"{base}/out", f"{base}/ck", "2024-02-01 00:00:00", "g")
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out/tweet").drop("batch_id")
    batch = stat.tweet_rows(stat.parse_statuses(spark.read.text(land)), "2024-02-01 00:00:00", "g") \
        .where(~F.col("coordinates").startswith("[50.0"))
    assert sorted(got.collect()) == sorted(batch.collect())
    users = spark.read.parquet(f"{base}/out/user").count()
    assert users == batch.where(F.col("user").isNotNull()).count()
    # watermark dedupe + window counts = distinct ids per 3-h window
    q2 = st.run_window_counts(st.in_box(st.status_stream(spark, land, max_files=1), (0.0, 0.0, 10.0, 10.0)),
                              f"{base}/bins", f"{base}/ck2", delay="60 days")
    q2.awaitTermination()
    wc = {r.bin: r.n for r in st.latest_window_counts(spark, f"{base}/bins").collect()}
    assert sum(wc.values()) == 40
    assert st.dropped_late(q2) == 0
    square = spark.createDataFrame([(0, 1, "A", [(0.0, 0.0), (6.0, 0.0), (6.0, 10.0), (0.0, 10.0), (0.0, 0.0)])],
                                   "pos long, num int, name string, ring array<struct<x double, y double>>")
    polys = geo.polygons_from_rings(square, "pos", "num", "name", "ring")
    labelled = st.label_statuses(st.in_box(st.status_stream(spark, land, max_files=1), (0.0, 0.0, 10.0, 10.0)), polys)
    q4 = st.run_window_counts(labelled, f"{base}/nbins", f"{base}/ck4", delay="60 days", nhood_col="FID_nhood")
    q4.awaitTermination()
    per = st.latest_window_counts(spark, f"{base}/nbins")
    totals = {r.bin: r.t for r in per.groupBy("bin").agg(F.sum("n").alias("t")).collect()}
    assert totals == wc and {r.FID_nhood for r in per.collect()} <= {"1,A", None}
    q3 = st.run_running_count(stream, f"{base}/total", f"{base}/ck3")
    q3.awaitTermination()
    assert st.read_running_count(spark, f"{base}/total").first().statuses == 50


def test_interval_trigger_matches_one_off(spark):
    docs = [_doc(i, 1.0 + i % 5, 2.0, user=i % 2 == 0) for i in range(12)]
    base, land = _land([docs[:6], docs[6:]])
    q = st.run_entity_sink(st.status_stream(spark, land, max_files=1), f"{base}/a", f"{base}/cka",
                           "2024-02-01 00:00:00", "g", trigger="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    q2 = st.run_entity_sink(st.status_stream(spark, land), f"{base}/b", f"{base}/ckb", "2024-02-01 00:00:00", "g")
    q2.awaitTermination()
    a = sorted(spark.read.parquet(f"{base}/a/tweet").drop("batch_id").collect())
    b = sorted(spark.read.parquet(f"{base}/b/tweet").drop("batch_id").collect())
    assert a == b and len(a) == 12


def test_a_batch_that_fails_before_the_pointer_leaves_the_last_total(spark, monkeypatch):
    """The version is written, the pointer not moved: readers keep the old total; the restarted query ends right."""
    base = tempfile.mkdtemp(prefix="geoseries-st3-")
    docs = S.status_docs(spark, SF_SMALL).select("value").limit(60).cache()
    docs.coalesce(1).write.text(f"{base}/landing")
    run = lambda: st.run_running_count(st.status_stream(spark, f"{base}/landing", max_files=1), f"{base}/total", f"{base}/ck")
    assert st.read_running_count(spark, f"{base}/total").count() == 0
    run().awaitTermination()
    assert st.read_running_count(spark, f"{base}/total").first().statuses == 60
    docs.coalesce(1).write.mode("append").text(f"{base}/landing")

    def broken(*args):
        raise RuntimeError("lost before the pointer")
    with monkeypatch.context() as m:
        m.setattr(st, "write_pointer", broken)
        with pytest.raises(Exception, match="lost before the pointer"):
            run().awaitTermination()
    versions = [f for f in os.listdir(f"{base}/total") if f.startswith("version=")]
    assert len(versions) == 2 and st.read_running_count(spark, f"{base}/total").first().statuses == 60
    run().awaitTermination()
    assert st.read_running_count(spark, f"{base}/total").first().statuses == 120


def test_a_parse_of_some_attributes_keeps_what_a_full_parse_keeps(spark):
    """Cut lines, broken characters and values of another type give the same rows either way."""
    d = _doc(7, 1.5, 2.5, place=True)
    d = d[:-1] + ', "coordinates": {"coordinates": [3.5, 4.5], "type": "Point"}}'
    lines = [d[:i] for i in range(0, len(d) + 1, 3)] + [d[:i] + c + d[i + 1:] for i in range(0, len(d), 5) for c in '"}x']
    o = json.loads(d)
    lines += [json.dumps(o | {k: v}) for k in o for v in (None, 1, "s", [1], {"a": [2]}, {"coordinates": ["x", 1]}, {"id_str": 3, "followers_count": "q"})]
    rows = spark.createDataFrame([(x,) for x in [*lines, None, "", f"[{d}]", d + d]], "value string").coalesce(1).cache()
    for fields in (st.WINDOW_FIELDS, ["coordinates"]):
        some, full = stat.parse_statuses(rows, fields=fields), stat.parse_statuses(rows).select(*fields)
        assert some.schema == full.schema and some.collect() == full.collect()
    kept = [r.id_str for r in stat.parse_statuses(rows).select("id_str").collect()]
    assert len(kept) == rows.count() and None in kept and "7" in kept


def test_a_replayed_status_is_not_located_again(spark, monkeypatch):
    """The points are looked up behind the de-duplication, with the same counts as before it."""
    docs = [_doc(i, 1.0 + i % 9, 2.0) for i in range(40)] + [json.dumps(json.loads(_doc(50 + i, 0, 0)) | {"coordinates": None}) for i in range(3)]
    base, land = _land([docs[:20], docs[20:], docs, docs[:5]])
    square = spark.createDataFrame([(0, 1, "A", [(0.0, 0.0), (6.0, 0.0), (6.0, 10.0), (0.0, 10.0), (0.0, 0.0)])],
                                   "pos long, num int, name string, ring array<struct<x double, y double>>")
    polys = geo.polygons_from_rings(square, "pos", "num", "name", "ring")
    located, label = [], st.label_points
    monkeypatch.setattr(st, "label_points", lambda df, *a, **k: located.append(df) or label(df, *a, **k))
    feed = lambda: st.status_stream(spark, land, 1, st.WINDOW_FIELDS)
    st.run_window_counts(feed(), f"{base}/a", f"{base}/cka", "60 days", nhood_col="FID_nhood", polys=polys).awaitTermination()
    behind = located.pop()._jdf.queryExecution().analyzed().toString()
    st.run_window_counts(st.label_statuses(feed(), polys), f"{base}/b", f"{base}/ckb", "60 days", nhood_col="FID_nhood").awaitTermination()
    before = located.pop()._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in behind and "DeduplicateWithinWatermark" not in before
    a, b = (sorted(map(str, st.latest_window_counts(spark, f"{base}/{x}").collect())) for x in "ab")
    per = st.latest_window_counts(spark, f"{base}/a").collect()
    assert a == b and sum(r.n for r in per) == 43 and {r.FID_nhood for r in per} == {"1,A", None}
