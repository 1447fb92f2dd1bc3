"""Rows that must not go unseen: refused casts, error and cut pages, bad geometries, page order."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoseries.functions.casts import checked_number, checked_timestamp
from geoseries.operators import clean, geo
from geoseries.plans import standins as S
from geoseries.sources import pages

from conftest import SF_SMALL


def test_reasons(spark):
    texts = ["12", " 1,234 ", "300", "2.5", "x", "", None, "NaN", "-inf", "+7", "1e400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    small = {r.t: (r.s.value, r.s.reason) for r in df.select("t", checked_number("t", "tinyint", True).alias("s")).collect()}
    assert small == {"12": (12, None), " 1,234 ": (None, "out_of_range"), "300": (None, "out_of_range"), "2.5": (None, "not_whole"),
                     "x": (None, "not_a_number"), "": (None, "missing"), None: (None, "missing"), "NaN": (None, "not_finite"),
                     "-inf": (None, "not_finite"), "+7": (7, None), "1e400": (None, "out_of_range")}
    wide = {r.t: (r.s.value, r.s.reason) for r in df.select("t", checked_number("t", "double").alias("s")).collect()}
    assert wide[" 1,234 "] == (1234.0, None) and wide["2.5"] == (2.5, None) and wide[None] == wide[""] == (None, None)
    assert wide["NaN"][1] == "not_finite" and wide["1e400"] == (None, "out_of_range")
    times = spark.createDataFrame([("2020-01-01 02:03:04",), ("01/02/2020",), (None,)], "t string")
    got = {r.t: r.s.reason for r in times.select("t", checked_timestamp("t").alias("s")).collect()}
    assert got == {"2020-01-01 02:03:04": None, "01/02/2020": "not_a_timestamp", None: None}


def test_strict_mode_raises_whatever_is_read(spark):
    dirty, good = S.calls_dirty(spark, SF_SMALL), S.calls_raw(spark, SF_SMALL)
    with pytest.raises(Exception, match="refused cast in file . column (call_timestamp|priority|longitude|latitude|incident_id)"):
        clean.stage_calls(dirty, "raise").select("category").collect()
    with pytest.raises(Exception, match="refused cast"):
        clean.clean_calls(dirty, S.polygons(spark, SF_SMALL), [], on_reject="raise").agg(F.count("*")).collect()
    assert clean.stage_calls(good, "raise").count() == clean.stage_calls(good).count()
    with pytest.raises(ValueError):
        clean.stage_calls(good, "ignore")


def test_no_row_is_lost_and_each_reject_counted(spark):
    dirty = S.calls_dirty(spark, SF_SMALL)
    staged = clean.stage_calls(dirty, "keep")
    assert staged.count() == clean.rule_filtered(dirty).count()
    refused = staged.where(F.size("rejects") > 0)
    assert refused.count() == clean.rejected_calls(dirty).count() > 0
    audit = clean.calls_stage_audit(dirty).agg(F.sum("with_rejects")).first()[0]
    assert audit == refused.count()
    assert staged.select(F.explode("rejects")).count() == clean.call_reject_audit(dirty).agg(F.sum("rows")).first()[0]
    plan = clean.stage_calls(dirty)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()   # reasons cost nothing where nobody reads them


ATTRS = T.StructType([T.StructField("incident_id", T.LongType())])
PAGES = [(1, '{"features": [{"attributes": {"incident_id": 1}}, {"attributes": {"incident_id": 2}}], "exceededTransferLimit": true}'),
         (2, '{"error": {"code": 400, "message": "Invalid query"}}'), (3, '{"features": [{"attributes": {"inci'), (4, '{"features": []}'),
         (5, "not json"), (6, "[]"), (7, '{"status": 1}'), (8, None)]


def test_pages_are_classed(spark):
    df = spark.createDataFrame(PAGES, "page_no long, text string")
    schema = pages.feature_page_schema(ATTRS)
    got = {r.page_no: r.page_class for r in pages.parsed_pages(df, schema).collect()}
    assert got[1] == "ok" and got[2] == "error" and got[3] == "corrupt" and got[4] == "empty" and got[5] == "corrupt" and got[7] == "no_features"
    assert got[6] in ("corrupt", "no_features") and got[8] == "corrupt"
    errors = {(r.page_class, r.error_code): (r.pages, r.rows) for r in pages.page_errors(df, schema).collect()}
    assert errors[("error", 400)] == (1, 0) and errors[("ok", None)] == (1, 2)
    audit = {r.page_no: (r.rows, r.consistent) for r in pages.page_audit(df, schema).collect()}
    assert audit[1] == (2, True) and audit[2] == (0, False) and audit[8] == (0, False)


def test_merge_refuses_or_drops_bad_pages(spark):
    df = spark.createDataFrame(PAGES, "page_no long, text string")
    with pytest.raises(Exception, match="page 2 cannot be merged: error 400 Invalid query"):
        pages.feature_rows(df.where("page_no <= 2"), ATTRS).collect()
    with pytest.raises(Exception, match="corrupt"):
        pages.feature_rows(df.where("page_no in (1, 3)"), ATTRS).select("page_no").collect()
    assert [r.incident_id for r in pages.feature_rows(df, ATTRS, on_bad="drop").orderBy("incident_id").collect()] == [1, 2]
    assert pages.feature_rows(df.where("page_no in (1, 4)"), ATTRS).count() == 2


def test_page_order(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (2, 0, 8), (2, 1, 8), (3, 0, 8), (3, 1, 4), (5, 0, 1)], "page_no long, feature_pos int, id long")
    got = {r.page_no: (r.ascending, r.follows) for r in pages.page_order_audit(rows, "id").collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (False, False), 5: (True, True)}
    assert [r.id for r in pages.rows_by_id(rows, "id").collect()] == [1, 4, 5, 7, 8, 8, 8]


def test_geometry_reasons(spark):
    ring = "[[[0,0],[4,0],[4,4],[0,4],[0,0]]]"
    rows = [(0, "Polygon", ring), (1, "MultiPolygon", f"[{ring}]"), (2, None, ring), (3, "Polygon", None), (4, "Polygon", "[[[0,0],[4"),
            (5, "Polygon", "[[[0,0],[4,0],[0,0]]]"), (6, "Polygon", "[[[0,0],[4,0],[4,4]]]"), (7, "Polygon", "[]"), (8, "Polygon", "[[[0],[4,0],[4,4]]]")]
    df = spark.createDataFrame(rows, "n int, t string, c string").withColumn("name", F.lit("x"))
    p = geo.polygons_from_table(df, "n", "name", "c", "n", "t")
    got = {r.nhood_num: r.reason for r in p.collect()}
    assert got == {0: None, 1: "not_a_polygon", 2: "not_a_polygon", 3: "bad_coordinates", 4: "bad_coordinates", 5: "too_few_points", 6: None, 7: "bad_coordinates", 8: "bad_coordinates"}
    audit = {r.reason: r.rows for r in geo.geometry_audit(df, "c", "t").collect()}
    assert audit == {"ok": 1, "closed_here": 1, "not_a_polygon": 2, "bad_coordinates": 4, "too_few_points": 1}
    assert p.where("valid").count() == 2
