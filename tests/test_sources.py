"""File sources: multi-glob CSV with file order, landed pages, neighbourhood CSV, wide forecast."""
import json
import os
import tempfile

from pyspark.sql import types as T

from geoseries.operators import clean
from geoseries.sources import files, pages


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_calls_csv_two_years_keep_first(spark):
    d = tempfile.mkdtemp(prefix="geoseries-csv-")
    head = "incident_id,call_timestamp_EST,officerinitiated,priority,calldescription,category,neighborhood,longitude,latitude\n"
    _write(f"{d}/calls_2019_part0.csv", head + '"1,001",2019-05-01 10:00:00,No, 3 ,x,ASSLT,A,1.0,1.0\n'
                                            '"1,002",2019-05-01 11:00:00,No,P,x,ASSLT,A,1.0,1.0\n')
    _write(f"{d}/calls_2020_part0.csv", head + '"1,001",2020-05-01 10:00:00,No,2,x,ASSLT,A,1.0,1.0\n'
                                            '"1,002",2020-05-01 11:00:00,No,4,x,ASSLT,A,1.0,1.0\n')
    raw = files.read_calls_csv(spark, files.year_globs(d, [2019, 2020]))
    first = clean.keep_first(clean.stage_calls(raw), ["incident_id"], clean.ORDER_COLS)
    got = {r.incident_id: (r.priority, str(r.call_timestamp)) for r in first.collect()}
    # 1001: first copy (2019) kept; 1002: 2019 copy filtered (priority P) -> 2020 copy survives
    assert got == {1001: (3, "2019-05-01 10:00:00"), 1002: (4, "2020-05-01 11:00:00")}


def test_read_pages_whole_files(spark):
    d = tempfile.mkdtemp(prefix="geoseries-pages-")
    for i, feats in enumerate([[1, 2], [3]]):
        doc = {"features": [{"attributes": {"incident_id": f, "call_timestamp": 1704067200000 + f},
                             "geometry": {"x": 1.0, "y": 2.0}} for f in feats]}
        if i == 0:
            doc["exceededTransferLimit"] = True
        _write(f"{d}/page_{i:03d}.json", json.dumps(doc, indent=2))
    attrs = T.StructType([T.StructField("incident_id", T.LongType()), T.StructField("call_timestamp", T.LongType())])
    pg = pages.read_pages(spark, d)
    rows = pages.feature_rows(pg, attrs).orderBy("incident_id").collect()
    assert [(r.page_no, r.incident_id) for r in rows] == [(1, 1), (1, 2), (2, 3)]
    assert str(rows[0].call_timestamp_EST) == "2023-12-31 19:00:00.001000"
    audit = {r.page_no: r for r in pages.page_audit(pg, pages.feature_page_schema(attrs)).collect()}
    assert audit[1].offset == 0 and audit[2].offset == 2 and audit[1].consistent and audit[2].consistent


def test_neighbourhood_csv_duplicate_key(spark):
    d = tempfile.mkdtemp(prefix="geoseries-nh-")
    _write(f"{d}/n.csv", 'nhood_num,nhood_name,geometry.type,geometry.coordinates\n'
                         '5,A,Polygon,"[[[0,0],[1,0],[1,1],[0,0]]]"\n'
                         '6,B,Polygon,"[[[5,5],[6,5],[6,6],[5,5]]]"\n'
                         '5,A,Polygon,"[[[2,2],[3,2],[3,3],[2,2]]]"\n')
    p = {r.key: r for r in files.read_neighbourhoods_csv(spark, f"{d}/n.csv").collect()}
    assert set(p) == {"5,A", "6,B"}
    assert p["5,A"].minx == 2.0 and p["5,A"].file_pos < p["6,B"].file_pos


def test_wide_forecast_scan(spark):
    d = tempfile.mkdtemp(prefix="geoseries-wide-")
    _write(f"{d}/f.csv", '"1,A","2,B",Day,Hour\n1.5,2.0,15,0\n1.0,3.5,15,3\n')
    df = files.read_wide_forecast(spark, f"{d}/f.csv")
    assert dict(df.dtypes) == {"1,A": "double", "2,B": "double", "Day": "int", "Hour": "int"}
    assert df.count() == 2


def test_landed_calls_prune_date_partitions(spark):
    from pyspark.sql import functions as F
    from conftest import SF_SMALL
    from geoseries.plans import standins as S
    d = tempfile.mkdtemp(prefix="geoseries-land-")
    raw = S.calls_raw(spark, SF_SMALL)
    cols = [c for c in raw.columns if c not in clean.ORDER_COLS]
    for seq in (1, 2):
        (raw.where(F.col("file_seq") == seq).orderBy("row_seq").select(*cols).coalesce(1).write
            .option("header", True).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(f"{d}/csv/y{seq}"))
    files.land_calls(spark, [f"{d}/csv/y1/*.csv", f"{d}/csv/y2/*.csv"], f"{d}/landed")
    part = files.read_landed_calls(spark, f"{d}/landed", "2024-01-10", "2024-01-17")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(call_date" in plan
    # ranged extraction: exact time range, then keep-first - same on the pruned copy and the full scan
    def first(df):
        st = clean.time_range(clean.stage_calls(df), "call_timestamp", "2024-01-10 00:00:00", "2024-01-17 00:00:00")
        return sorted(clean.keep_first(st, ["incident_id"], clean.ORDER_COLS)
                      .select("incident_id", "priority", "file_seq").collect())
    full = files.read_calls_csv(spark, [f"{d}/csv/y1/*.csv", f"{d}/csv/y2/*.csv"])
    assert first(part.drop("call_date")) == first(full)


def test_page_audit_offsets_across_buckets(spark):
    from pyspark.sql import functions as F
    n = 25000
    df = spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("page_no"),
        F.when(F.col("id") < n, F.lit('{"features": [1, 2, 3], "exceededTransferLimit": true}'))
        .otherwise(F.lit('{"features": [1]}')).alias("text"))
    sch = T.StructType([T.StructField("features", T.ArrayType(T.LongType())),
                        T.StructField("exceededTransferLimit", T.BooleanType())])
    r = {x.page_no: (x.offset, x.consistent) for x in pages.page_audit(df, sch).collect()}
    assert r[1] == (0, True) and r[10000] == (3 * 9999, True) and r[20001] == (3 * 20000, True)
    assert r[n] == (3 * (n - 1), True) and all(v[1] for v in r.values())
