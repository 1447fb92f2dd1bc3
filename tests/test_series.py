"""Golden G8 (lag rows, splits), G9 (ACF), PACF and decomposition against NumPy brute force."""
import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from geoseries.operators import series


def _long(spark, values, name="s"):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(name, t0 + dt.timedelta(hours=3 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, bin timestamp_ntz, value double")


def _wave(n=60):
    return [10 + 3 * math.sin(2 * math.pi * t / 8) + ((t * 7) % 5) / 2 + 0.05 * t for t in range(n)]


def test_acf_g9(spark):
    got = {r.lag: r.acf for r in series.acf(_long(spark, [1, 2, 3, 4, 5, 6]), 5).collect()}
    want = {0: 1.0, 1: 0.5, 2: 2 / 35, 3: 0.271429, 4: 0.428571, 5: 0.357143}
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-6
    best = series.best_lag(series.acf(_long(spark, [1, 2, 3, 4, 5, 6]), 5)).first()
    assert best.lag == 1


def test_acf_constant_series_is_null(spark):
    got = series.acf(_long(spark, [3, 3, 3, 3]), 2).collect()
    assert all(r.acf is None for r in got)


def _pacf_numpy(x, nlags):
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    r = np.array([np.sum(x[k:] * x[:n - k]) / (n - k) for k in range(nlags + 1)])
    r[0] = np.sum(x * x) / n
    out = [1.0]
    for k in range(1, nlags + 1):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(abs(np.linalg.solve(R, r[1:k + 1])[-1]))
    return out


def test_pacf_matches_yule_walker_solve(spark):
    x = _wave()
    got = {r.lag: r.pacf for r in series.pacf(_long(spark, x), 6).collect()}
    want = _pacf_numpy(x, 6)
    for k in range(7):
        assert abs(got[k] - want[k]) < 1e-9


def test_lag_rows_g8(spark):
    rows = series.lag_rows(_long(spark, [1, 2, 3, 4, 5, 6]), 2).orderBy("row_idx").collect()
    assert [(list(r.lags), r.y) for r in rows] == [([1.0, 2.0], 3.0), ([2.0, 3.0], 4.0),
                                                    ([3.0, 4.0], 5.0), ([4.0, 5.0], 6.0)]
    assert [r.row_idx for r in rows] == [0, 1, 2, 3]


def test_split_g8(spark):
    s = series.ts_split(_long(spark, list(range(11))), 0.2, 0.2)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 6, "validation": 2, "test": 3}
    s2 = series.ts_split(_long(spark, list(range(11))), 3, 2)
    counts = {r.split: r["count"] for r in s2.groupBy("split").count().collect()}
    assert counts == {"train": 6, "validation": 2, "test": 3}
    # chronological: every test bin is after every train bin
    b = {r.split: r for r in s.groupBy("split").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).collect()}
    assert b["train"].hi < b["validation"].lo <= b["validation"].hi < b["test"].lo


def test_split_shared_by_all_series(spark):
    df = _long(spark, list(range(10)), "a").unionByName(_long(spark, list(range(10)), "b"))
    s = series.ts_split(df, 0.2, 0.2)
    by = {}
    for r in s.collect():
        by.setdefault(r.bin, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())


def _decompose_numpy(x, m):
    x = np.asarray(x, float)
    n, h = len(x), m // 2
    w = np.array([0.5] + [1.0] * (m - 1) + [0.5]) / m if m % 2 == 0 else np.ones(m) / m
    trend = np.full(n, np.nan)
    for t in range(h, n - h):
        trend[t] = np.sum(w * x[t - h:t + h + 1])
    det = x - trend
    pm = np.array([np.nanmean(det[i::m]) for i in range(m)])
    pm -= pm.mean()
    seasonal = np.tile(pm, n // m + 1)[:n]
    return trend, seasonal, x - trend - seasonal


def test_decompose_matches_numpy(spark):
    x = _wave(48)
    got = series.decompose(_long(spark, x), 8).orderBy("bin").collect()
    trend, seasonal, resid = _decompose_numpy(x, 8)
    for i, r in enumerate(got):
        if np.isnan(trend[i]):
            assert r.trend is None
        else:
            assert abs(r.trend - trend[i]) < 1e-9 and abs(r.resid - resid[i]) < 1e-9
        assert abs(r.seasonal - seasonal[i]) < 1e-9
        if r.trend is not None:
            assert abs(r.trend + r.seasonal + r.resid - r.observed) < 1e-9


def test_series_index_first_seen(spark):
    df = _long(spark, [1, 2, 3], "z").unionByName(
        _long(spark, [1, 2, 3, 4], "a").withColumn("bin", F.col("bin") + F.expr("INTERVAL 1 HOUR")))
    got = {r.series: r.idx for r in series.series_index(df).collect()}
    assert got == {"z": 0, "a": 1}


def test_joint_lag_rows(spark):
    df = _long(spark, [1, 2, 3, 4, 5], "b").unionByName(_long(spark, [10, 20, 30, 40, 50], "a"))
    rows = series.joint_lag_rows(df, 2).orderBy("row_idx").collect()
    # both series start together: order by key -> a first
    assert [(list(r.lags), list(r.y)) for r in rows] == [
        ([10.0, 1.0, 20.0, 2.0], [30.0, 3.0]), ([20.0, 2.0, 30.0, 3.0], [40.0, 4.0]),
        ([30.0, 3.0, 40.0, 4.0], [50.0, 5.0])]


def test_decompose_needs_two_periods(spark):
    import pytest
    with pytest.raises(Exception, match="at least 16"):
        series.decompose(_long(spark, list(range(10))), 8).collect()


def test_short_series_give_null_not_errors(spark):
    got = series.pacf(_long(spark, [1, 2, 3, 5]), 4).collect()
    assert any(r.pacf is None for r in got)
