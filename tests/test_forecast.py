"""Golden G7 (losses), G10 (recursive forecast), G11 (RF grid); AR grid vs NumPy brute force."""
import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

import pytest
from geoseries.functions import metrics as M
from geoseries.operators import forecast, series


def test_losses_g7(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0)], "a double, p double")
    r = df.agg(M.mae("a", "p").alias("mae"), M.mse("a", "p").alias("mse"), M.mape("a", "p").alias("mape"),
               M.smape("a", "p").alias("smape")).first()
    assert r.mae == 1.0 and abs(r.mse - 5 / 3) < 1e-12 and abs(r.mape - 50) < 1e-9
    assert abs(r.smape - 22.222222) < 1e-6
    z = df.unionByName(spark.createDataFrame([(0.0, 1.0)], "a double, p double"))
    r = z.agg(M.mape("a", "p").alias("mape"), M.zero_denominators("a", "p").alias("z")).first()
    assert abs(r.mape - 50) < 1e-9 and r.z == 1
    assert M.loss_func("sMAPE") is M.smape


def test_recursive_forecast_g10(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0])], "row_idx int, lags array<double>")
    got = [r.pred for r in forecast.linear_recursive(rows, [1.0, 1.0], 0.0, 3).orderBy("step").collect()]
    assert got == [3.0, 5.0, 8.0]


def test_candidate_grid_g11():
    trees, depths = range(50, 200, 50), range(1, 6, 2)
    assert forecast.candidate_grid(trees, depths) == [(n, d) for n in (50, 100, 150) for d in (1, 3, 5)]
    with pytest.raises(ValueError):
        forecast.candidate_grid([50], [31])


def test_ar_grid_orders_zero_and_high_differences(spark):
    """p = 0 is the mean of the differenced series; a cubic has constant third differences."""
    rows = [("c", i, float(i ** 3), "train" if i < 30 else "validation") for i in range(38)]
    split = spark.createDataFrame(rows, "series string, bin int, value double, split string")
    got = {(r.p, r.d): r for r in forecast.ar_grid(split, (0, 3), (0, 4), 0, 8, "MSE").collect()}
    assert sorted(got) == [(p, d) for p in range(3) for d in range(4)]
    assert [got[k].cand_idx for k in sorted(got)] == list(range(12))
    assert got[0, 3].loss < 1e-12
    mean = sum(i ** 3 for i in range(30)) / 30
    assert abs(got[0, 0].loss - sum((i ** 3 - mean) ** 2 for i in range(30, 38)) / 8) < 1e-3
    step = 29 ** 3 / 29
    assert abs(got[0, 1].loss - sum((i ** 3 - 29 ** 3 - step * (i - 29)) ** 2 for i in range(30, 38)) / 8) < 1e-3


def test_best_of_grid_ties_and_nulls(spark):
    c = spark.createDataFrame([("s", 0, 2.0), ("s", 1, 1.0), ("s", 2, 1.0), ("s", 3, None), ("s", 4, float("nan"))],
                              "series string, cand_idx int, loss double")
    assert forecast.best_of_grid(c).first().cand_idx == 1


def _backtest_numpy(y, lags, fh, w):
    out = []
    for i in range(len(y) - fh + 1):
        cur, preds = list(lags[i]), []
        for _ in range(fh):
            p = sum(a * b for a, b in zip(cur, w))
            preds.append(p)
            cur = cur[1:] + [p]
        out.append(np.mean((np.array(y[i:i + fh]) - np.array(preds)) ** 2))
    return float(np.mean(out)), len(out)


def test_backtest_matches_brute_force(spark):
    vals = [float((t * 7) % 11 + t % 3) for t in range(30)]
    lag = 3
    rows = [("s", i, vals[i:i + lag], vals[i + lag]) for i in range(len(vals) - lag)]
    df = spark.createDataFrame(rows, "series string, row_idx int, lags array<double>, y double")
    w = [0.2, 0.3, 0.5]
    got = forecast.backtest(df, 4, lambda o: forecast.linear_recursive(o, w, 0.0, 4)).first()
    want, n = _backtest_numpy([r[3] for r in rows], [r[2] for r in rows], 4, w)
    assert got.origins == n and abs(got.loss - want) < 1e-9


def _ar_numpy(x, p, d, season, fh):
    x = np.asarray(x, float)
    y = x[season:] - x[:-season]
    z = y if d == 0 else y[1:] - y[:-1]
    mu = z.mean()
    zc = z - mu
    n = len(z)
    s = np.array([np.sum(zc[k:] * zc[:n - k]) for k in range(p + 1)])
    rho = s / s[0]
    R = np.array([[rho[abs(i - j)] for j in range(p)] for i in range(p)])
    phi = np.linalg.solve(R, rho[1:p + 1])
    zh, xh, yl, out = list(z), list(x), y[-1], []
    for _ in range(fh):
        zp = mu + sum(phi[i] * (zh[-1 - i] - mu) for i in range(p))
        yp = yl + zp if d == 1 else zp
        xp = yp + xh[-season]
        zh.append(zp), xh.append(xp), out.append(xp)
        yl = yp
    return out


def _long(spark, values):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", t0 + dt.timedelta(hours=3 * i), float(v)) for i, v in enumerate(values)],
                                 "series string, bin timestamp_ntz, value double")


def test_ar_forecast_matches_numpy(spark):
    x = [10 + 3 * math.sin(2 * math.pi * t / 8) + ((t * 7) % 5) / 2 + 0.1 * t for t in range(64)]
    got = forecast.ar_forecast(_long(spark, x), [1, 2, 3], [0, 1], 8, 8).collect()
    by = {}
    for r in got:
        by.setdefault((r.p, r.d), {})[r.step] = r.pred
    for p in (1, 2, 3):
        for d in (0, 1):
            want = _ar_numpy(x, p, d, 8, 8)
            assert all(abs(by[(p, d)][s + 1] - want[s]) < 1e-7 for s in range(8)), (p, d)


def test_ar_grid_scores_and_picks(spark):
    x = [10 + 3 * math.sin(2 * math.pi * t / 8) + ((t * 7) % 5) / 2 + 0.1 * t for t in range(80)]
    split = series.ts_split(_long(spark, x), 0.2, 0.2)
    cands = forecast.ar_grid(split, (1, 3), (0, 2), 8, 8, "MSE").collect()
    assert sorted((r.p, r.d, r.cand_idx) for r in cands) == [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 1, 3)]
    tr = [r.value for r in split.where("split = 'train'").orderBy("bin").collect()]
    va = [r.value for r in split.where("split = 'validation'").orderBy("bin").collect()][:8]
    for r in cands:
        want = float(np.mean((np.array(va) - np.array(_ar_numpy(tr, r.p, r.d, 8, 8))) ** 2))
        assert abs(r.loss - want) < 1e-7
    best = forecast.best_of_grid(forecast.ar_grid(split, (1, 3), (0, 2), 8, 8)).first()
    assert best.loss == min(r.loss for r in cands)
    hold = forecast.ar_holdout(split, forecast.best_of_grid(forecast.ar_grid(split, (1, 3), (0, 2), 8, 8)), 8, 8)
    assert hold.count() == 1


def test_model_recursive_with_ml_model(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        a, b = rng.random(2)
        rows.append((i, [float(a), float(b)], float(0.5 * a + 0.25 * b + 1.0)))
    df = spark.createDataFrame(rows, "row_idx int, lags array<double>, y double")
    model = LinearRegression(featuresCol="features", labelCol="y").fit(
        df.select(array_to_vector("lags").alias("features"), "y"))
    origin = df.limit(3).withColumn("series", F.lit("s")).withColumnRenamed("row_idx", "origin")
    got = forecast.model_recursive(model, origin, 3, ["series", "origin"]).collect()
    ref = forecast.linear_recursive(origin, [0.5, 0.25], 1.0, 3).collect()
    want = {(r.origin, r.step): r.pred for r in ref}
    assert all(abs(r.pred - want[(r.origin, r.step)]) < 1e-6 for r in got)


def test_joint_recursive_appends_vectors(spark):
    # two series, lag 2: lags = [a_{t-2}, b_{t-2}, a_{t-1}, b_{t-1}]
    rows = spark.createDataFrame([(0, [1.0, 10.0, 2.0, 20.0])], "row_idx int, lags array<double>")
    w = [[0.0, 0.0, 1.0, 0.0],      # a_t = a_{t-1}
         [0.0, 1.0, 0.0, 1.0]]      # b_t = b_{t-2} + b_{t-1}
    got = {(r.step, r.series_pos): r.pred
           for r in forecast.linear_recursive_joint(rows, w, [1.0, 0.0], 3).collect()}
    assert [got[(s, 0)] for s in (1, 2, 3)] == [3.0, 4.0, 5.0]
    assert [got[(s, 1)] for s in (1, 2, 3)] == [30.0, 50.0, 80.0]


def test_ar_forecast_short_history_is_null(spark):
    got = forecast.ar_forecast(_long(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 11.0]), [3], [1], 8, 2).collect()
    assert all(r.pred is None for r in got)


def test_rf_grid_is_deterministic_and_follows_the_grid(spark):
    vals = [float((t * 7) % 11 + (t % 8)) for t in range(80)]
    rows = [("s", i, vals[i:i + 3], vals[i + 3]) for i in range(len(vals) - 3)]
    df = spark.createDataFrame(rows, "series string, row_idx int, lags array<double>, y double")
    train, val = df.where("row_idx < 60"), df.where("row_idx >= 60")
    a = sorted(tuple(r) for r in forecast.rf_grid(train, val, [50, 100], [1, 3], 4).collect())
    b = sorted(tuple(r) for r in forecast.rf_grid(train, val, [50, 100], [1, 3], 4).collect())
    assert a == b
    assert [(r[1], r[2]) for r in a] == [(50, 1), (50, 3), (100, 1), (100, 3)]
    assert all(r[3] is not None and r[3] >= 0 for r in a)


def test_joint_weights_as_a_table_of_200_series(spark):
    """Plan and rows do not grow with the 200 x 1,600 weights; results as by hand."""
    k, lag, fh = 200, 8, 3
    rnd = np.random.default_rng(3)
    weights = rnd.random((k, k * lag)) * (rnd.random((k, k * lag)) < 0.05) / 40
    const = rnd.random(k)
    lags = rnd.random((2, k * lag))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(lags)], "row int, lags array<double>")
    out = forecast.linear_recursive_table(rows, forecast.weight_table(weights.tolist(), const.tolist(), spark), k, fh, ["row"])
    got = {(r.row, r.step, r.series_pos): r.pred for r in out.collect()}
    assert len(got) == 2 * fh * k
    for i in range(2):
        state = lags[i].copy()
        for s in range(1, fh + 1):
            new = weights @ state + const
            assert all(abs(got[i, s, j] - new[j]) < 1e-9 for j in range(k))
            state = np.concatenate([state[k:], new])


def test_holdout_is_one_plan(spark):
    """The chosen orders travel with the rows: nothing is collected, a choice beyond the grid raises."""
    rows = [(f"s{j}", i, float((i * (j + 2)) % 7 + (i % 8) * j), "test" if i >= 56 else "validation" if i >= 48 else "train") for j in range(3) for i in range(64)]
    split = spark.createDataFrame(rows, "series string, bin int, value double, split string")
    best = spark.createDataFrame([("s0", 1, 0), ("s1", 0, 1), ("s2", 2, 2)], "series string, p int, d int")
    got = {r.series: (r.p, r.d, r.loss) for r in forecast.ar_holdout(split, best, p_range=(0, 3), d_range=(0, 3)).collect()}
    every = forecast.ar_forecast(split.where("split <> 'test'"), [0, 1, 2], [0, 1, 2], 8, 8)
    test = {(r.series, r.bin - 55): r.value for r in split.where("split = 'test'").collect()}
    for s, p, d in (("s0", 1, 0), ("s1", 0, 1), ("s2", 2, 2)):
        pred = every.where((F.col("series") == s) & (F.col("p") == p) & (F.col("d") == d)).collect()
        want = sum((r.pred - test[s, r.step]) ** 2 for r in pred) / 8
        assert got[s][:2] == (p, d) and abs(got[s][2] - want) < 1e-9
    with pytest.raises(Exception, match="beyond p_max or d_max"):
        forecast.ar_holdout(split, best, p_range=(0, 2), d_range=(0, 2)).collect()


def _forest(spark, depth=4, trees=5):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor
    rnd = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v], float(v[0] * 3 + v[1] * v[2] + rnd.normal() / 9)) for i, v in enumerate(rnd.random((300, 3)))]
    df = spark.createDataFrame(rows, "i int, lags array<double>, y double")
    ready = df.withColumn("features", array_to_vector("lags"))
    return df, ready, RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=1, labelCol="y").fit(ready)


def test_forest_table_predicts_as_the_model(spark):
    """The node table, walked by a fold and walked in SQL, gives the model's predictions."""
    import duckdb
    df, ready, model = _forest(spark)
    nodes = forecast.forest_nodes(model)
    want = {r.i: r.prediction for r in model.transform(ready).select("i", "prediction").collect()}
    packed = forecast.packed_forests(nodes.withColumn("k", F.lit(0)), ["k"])
    rows = df.withColumn("k", F.lit(0)).join(packed, "k")
    got = {r.i: r.p for r in rows.select("i", forecast.forest_predict(F.col("forest"), F.col("lags"), 4).alias("p")).collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
    table, points = nodes.toPandas(), df.toPandas()
    walked = duckdb.sql("""WITH RECURSIVE w AS (SELECT i, lags, tree, id, "left", "right", feature, threshold, prediction FROM points, "table" WHERE id = 0
        UNION ALL SELECT w.i, w.lags, n.tree, n.id, n."left", n."right", n.feature, n.threshold, n.prediction FROM w JOIN "table" n
        ON n.tree = w.tree AND n.id = CASE WHEN w.lags[w.feature + 1] <= w.threshold THEN w."left" ELSE w."right" END WHERE w."left" >= 0)
        SELECT i, avg(prediction) FROM w WHERE "left" < 0 GROUP BY i""").fetchall()
    assert len(walked) == 300 and all(abs(p - want[i]) < 1e-12 for i, p in walked)


def test_forest_recursion_equals_the_model_step_by_step(spark):
    df, _, model = _forest(spark, depth=3, trees=4)
    rows = df.select("i", "lags").limit(20)
    want = {(r.i, r.step): r.pred for r in forecast.model_recursive(model, rows, 5, ["i"]).collect()}
    packed = forecast.packed_forests(forecast.forest_nodes(model).withColumn("k", F.lit(0)), ["k"])
    out = forecast.forest_recursive(rows.withColumn("k", F.lit(0)).join(packed, "k"), 5, 3)
    got = {(r.i, r.step): r.pred for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
