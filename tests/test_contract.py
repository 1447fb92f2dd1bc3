"""Driver contract: entry(), queries() / oracle_sql() keys, and oracle agreement at sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"bin", "FID_nhood", "att_level"} <= set(df.columns)


def test_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    missing = sorted(k for k in q if k not in o and k not in E.LLM_QUERIES)
    assert missing == ["m03_rf_grid", "rf_grid"], missing


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ["attention_level", "clean_calls", "clean_posts_two_phase", "adjacency",
                                  "acf", "pacf", "decompose", "backtest", "page_merge", "box_stats",
                                  "working_series", "radius_match", "ar_grid", "ar_holdout"])
def test_oracle_agrees_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = _rows(E.queries()[name](spark, SF_SMALL).toPandas())
    want = _rows(con.execute(E.oracle_sql()[name]).df())
    assert got == want


def test_page_keys_later_page_wins(spark):
    from pyspark.sql import types as T
    from geoseries.sources import pages
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StringType())),
                           T.StructField("exceededTransferLimit", T.BooleanType()),
                           T.StructField("spatialReference", T.StringType())])
    df = spark.createDataFrame([(1, '{"features": [], "exceededTransferLimit": true, "spatialReference": "a"}'),
                                (2, '{"features": [], "spatialReference": "b"}')], "page_no int, text string")
    r = pages.page_keys(df, schema).first()
    assert r.spatialReference == "b" and r.exceededTransferLimit is True
