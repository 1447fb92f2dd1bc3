"""Recursive multi-step forecasts, back-tests and grid searches.

* A linear lag model (weights + intercept) is forecast for all series and all
  origins in one plan: the ``fh`` steps are a fold (``aggregate``) over the
  lag array, no driver loop.
* A ``pyspark.ml`` model needs one ``transform`` per step; the loop is over
  the horizon (a handful of steps) and each step's state is checkpointed to
  the shared checkpoint folder to keep the lineage short.
* The seasonal-AR grid (re-aimed order search): seasonal difference at the
  season lag, ``d`` regular differences, AR(p) coefficients from the
  Durbin-Levinson fold over the autocorrelations; every (series, p, d)
  candidate is scored in one plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import product
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import loss_func
from ..session import broadcast_if_small, cut_lineage, scratch_path


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


# ---- M1 --------------------------------------------------------------------------------
def linear_recursive(rows: DataFrame, weights: Sequence[float], intercept: float, fh: int,
                     lags_col: str = "lags") -> DataFrame:
    """Predict one step, shift the lag window left, append the prediction,
    repeat ``fh`` times (M1).  Adds ``step`` (1..fh) and ``pred``, one row per step."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    n = len(weights)
    init = F.struct(F.col(lags_col).cast("array<double>").alias("lags"),
                    F.array().cast("array<double>").alias("preds"))

    def step(acc, _s):
        pred = F.lit(float(intercept)) + _sum(F.zip_with(acc.lags, w, lambda a, b: a * b))
        return F.struct(F.concat(F.slice(acc.lags, 2, n - 1), F.array(pred)).alias("lags"),
                        F.concat(acc.preds, F.array(pred)).alias("preds"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(fh)), init, step).preds
    out = rows.select("*", F.posexplode(folded).alias("_p", "pred"))
    return out.withColumn("step", F.col("_p") + 1).drop("_p")


def linear_recursive_joint(rows: DataFrame, weights: Sequence[Sequence[float]], intercepts: Sequence[float],
                           fh: int, lags_col: str = "lags") -> DataFrame:
    """Joint recursive forecast (M1, all-series form): ``lags`` holds the last
    ``lag`` vectors of all ``k`` series flattened oldest->newest; output j is
    ``intercepts[j] + weights[j] . lags``; each step appends the whole
    predicted vector and drops the oldest one.  One row per (step, series
    position) with ``pred``."""
    k = len(intercepts)
    w = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    b = F.array(*[F.lit(float(x)) for x in intercepts])
    n = len(weights[0])
    init = F.struct(F.col(lags_col).cast("array<double>").alias("lags"),
                    F.array().cast("array<array<double>>").alias("preds"))

    def step(acc, _s):
        vec = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: b[j] + _sum(
            F.zip_with(acc.lags, w[j], lambda a, c: a * c)))
        return F.struct(F.concat(F.slice(acc.lags, k + 1, n - k), vec).alias("lags"),
                        F.concat(acc.preds, F.array(vec)).alias("preds"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(fh)), init, step).preds
    out = rows.select("*", F.posexplode(folded).alias("_p", "_vec"))
    out = out.select("*", F.posexplode("_vec").alias("series_pos", "pred"))
    return out.withColumn("step", F.col("_p") + 1).drop("_p", "_vec")


def weight_table(weights: Sequence[Sequence[float]], intercepts: Sequence[float], spark) -> DataFrame:
    """``(output, input, weight)`` of a joint linear model; input -1 is the constant."""
    rows = [(j, i, float(x)) for j, row in enumerate(weights) for i, x in enumerate(row) if x] + [(j, -1, float(b)) for j, b in enumerate(intercepts)]
    return spark.createDataFrame(rows, "output int, input int, weight double")


def linear_recursive_table(rows: DataFrame, weights: DataFrame, k: int, fh: int, keys: Sequence[str],
                           lags_col: str = "lags") -> DataFrame:
    """:func:`linear_recursive_joint` with the model as a table ``(output, input,
    weight)`` (:func:`weight_table`): a step is matrix times vector as a join on
    the input position and a sum per output, so neither the plan nor a row
    grows with the number of weights, and zero weights cost nothing.  One row
    per (keys, step, series position) with ``pred``; each step is written once."""
    keys = list(keys)
    w = cut_lineage(weights.select("output", "input", "weight"), "weights")
    w = broadcast_if_small(w, w.count() * 24)
    vector = rows.select(*keys, F.posexplode(F.col(lags_col).cast("array<double>")).alias("input", "value"))
    constant = rows.select(*keys, F.lit(-1).alias("input"), F.lit(1.0).alias("value"))
    sizes = rows.select(*keys, F.size(lags_col).alias("_n"))
    state, outs = cut_lineage(vector.unionByName(constant), "lag-vectors"), []
    for s in range(1, fh + 1):
        pred = state.join(w, "input").groupBy(*keys, "output").agg(F.sum(F.col("value") * F.col("weight")).alias("pred"))
        pred = cut_lineage(pred, "joint-step")
        outs.append(pred.select(*keys, F.lit(s).alias("step"), F.col("output").alias("series_pos"), "pred"))
        if s < fh:
            # the oldest vector leaves, the predicted one comes last
            shifted = state.where((F.col("input") < 0) | (F.col("input") >= k)).withColumn("input", F.when(F.col("input") < 0, F.col("input")).otherwise(F.col("input") - k))
            newest = pred.join(sizes, keys).select(*keys, (F.col("_n") - k + F.col("output")).alias("input"), F.col("pred").alias("value"))
            state = cut_lineage(shifted.unionByName(newest), "lag-vectors")
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def model_recursive(model, rows: DataFrame, fh: int, keys: Sequence[str],
                    lags_col: str = "lags") -> DataFrame:
    """Recursive forecast with a fitted ``pyspark.ml`` regressor whose features
    are the lag vector (M1, model form).  ``(keys..., step, pred)``."""
    from pyspark.ml.functions import array_to_vector
    cur = rows.select(*keys, F.col(lags_col).cast("array<double>").alias("lags"))
    outs = []
    for s in range(1, fh + 1):
        scored = model.transform(cur.withColumn("features", array_to_vector("lags")))
        step = cut_lineage(scored.select(*keys, "lags", F.col(model.getPredictionCol()).alias("pred")))
        outs.append(step.select(*keys, F.lit(s).alias("step"), "pred"))
        shifted = F.slice("lags", F.lit(2), F.greatest(F.size("lags") - 1, F.lit(0)))
        cur = step.select(*keys, F.concat(shifted, F.array("pred")).alias("lags"))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


# ---- M2 --------------------------------------------------------------------------------
def backtest(test_rows: DataFrame, fh: int, predict, metric: str = "MSE",
             series: str = "series") -> DataFrame:
    """Every origin i in 0..n-fh of each series' test rows: forecast fh steps
    recursively from the lags of row i, compare with the targets of rows
    i..i+fh-1, loss per origin, then the mean over origins (M2).

    ``predict(origin_rows) -> rows + (step, pred)``.
    """
    w = Window.partitionBy(series).orderBy("row_idx")
    t = test_rows.withColumn("_i", F.row_number().over(w) - 1) \
                 .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(series)))
    origins = t.where(F.col("_i") <= F.col("_n") - fh).select(series, F.col("_i").alias("origin"), "lags")
    preds = predict(origins)
    actual = t.select(series, F.col("_i").alias("_j"), F.col("y").alias("actual"))
    j = preds.join(actual, (preds[series] == actual[series]) &
                   (actual["_j"] == preds["origin"] + preds["step"] - 1)).drop(actual[series])
    per_origin = j.groupBy(series, "origin").agg(loss_func(metric)("actual", "pred").alias("loss"))
    return per_origin.groupBy(series).agg(F.count(F.lit(1)).alias("origins"), F.avg("loss").alias("loss"))


# ---- M4 / M5 / M6 ----------------------------------------------------------------------
def _ar_state(hist: DataFrame, p_max: int, d_max: int, season: int,
              series: str, order: str, value: str, carry: Sequence[str] = ()) -> DataFrame:
    """Per (series, d): AR coefficient arrays for orders 1..p_max and the state
    needed to forecast from the end of ``hist``, whose rows carry their degree of
    differencing in ``d`` (0..d_max); ``carry``: further columns that a (series, d) has one value of."""
    w = Window.partitionBy(series, "d").orderBy(order)
    x = F.col(value).cast("double")
    y = x - F.lag(x, season).over(w) if season else x

    def back(k):
        return F.lag(x, k).over(w) - (F.lag(x, season + k).over(w) if season else F.lit(0.0))

    def level(k):  # k-th difference of y: alternating binomial sums of y at lags 0..k
        return sum(((-1) ** j * comb(k, j) * back(j) for j in range(1, k + 1)), y)
    u = hist.select(series, "d", *carry, order, x.alias("_x"), F.array(*[level(k) for k in range(d_max + 1)]).alias("_levels"))
    u = u.withColumns({"_z": F.element_at("_levels", F.col("d") + 1), "_yd": F.slice("_levels", F.lit(1), F.col("d"))})
    wd = Window.partitionBy(series, "d").orderBy(order)
    wall = Window.partitionBy(series, "d")
    zc = F.col("_z") - F.avg("_z").over(wall)
    u = u.withColumn("_zc", zc).withColumn("_mu", F.avg("_z").over(wall))
    lagged = [F.lag(F.when(F.col("_z").isNotNull(), F.col("_zc")), k).over(wd).alias(f"_l{k}")
              for k in range(1, p_max + 1)]
    tail = max(p_max, season, 1)
    u = u.select(series, "d", *carry, order, "_x", "_yd", "_z", "_zc", "_mu", *lagged,
                 F.collect_list("_z").over(wd.rowsBetween(-(p_max - 1), 0)).alias("_zh"),
                 F.collect_list("_x").over(wd.rowsBetween(-(tail - 1), 0)).alias("_xh"),
                 F.row_number().over(Window.partitionBy(series, "d").orderBy(F.desc(order))).alias("_rk"))
    z_ok = F.col("_z").isNotNull()
    agg = u.groupBy(series, "d").agg(
        F.count_if(z_ok).alias("_n"),
        F.sum(F.when(z_ok, F.col("_zc") * F.col("_zc"))).alias("_s0"),
        *[F.sum(F.when(z_ok, F.col("_zc") * F.col(f"_l{k}"))).alias(f"_s{k}") for k in range(1, p_max + 1)],
        F.first("_mu").alias("mu"), *[F.first(c).alias(c) for c in carry],
        F.max_by("_zh", F.when(F.col("_rk") == 1, F.lit(1))).alias("zh"),
        F.max_by("_xh", F.when(F.col("_rk") == 1, F.lit(1))).alias("xh"),
        F.max_by("_yd", F.when(F.col("_rk") == 1, F.lit(1))).alias("ylast"))
    rho = F.array(*[F.try_divide(F.col(f"_s{k}"), F.col("_s0")) for k in range(0, p_max + 1)])
    return agg.withColumn("_dl", _dl_with_path(rho, p_max))


def _dl_with_path(rho: Column, p_max: int) -> Column:
    """Durbin-Levinson keeping every intermediate coefficient vector."""
    def dot(arr, fn):
        return F.aggregate(F.transform(arr, fn), F.lit(0.0), lambda s, x: s + x)
    init = F.struct(F.array().cast("array<double>").alias("phi"),
                    F.array().cast("array<array<double>>").alias("path"))

    def step(acc, k):
        phi = acc.phi
        num = rho[k] - dot(phi, lambda p, i: p * rho[k - 1 - i])
        den = F.lit(1.0) - dot(phi, lambda p, i: p * rho[i + 1])
        kk = F.try_divide(num, den)
        new_phi = F.concat(F.transform(phi, lambda p, i: p - kk * phi[k - 2 - i]), F.array(kk))
        return F.struct(new_phi.alias("phi"), F.concat(acc.path, F.array(new_phi)).alias("path"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(p_max)), init, step).path


def _ar_path_forecast(phi: Column, mu: Column, zh: Column, xh: Column, ylast: Column,
                      season: int, fh: int) -> Column:
    """Forecast fh steps: AR on the differenced scale, then undo the regular
    differences (``ylast``: the last value of each level) and the seasonal one."""
    init = F.struct(zh.cast("array<double>").alias("zh"), xh.cast("array<double>").alias("xh"),
                    ylast.cast("array<double>").alias("yl"), F.array().cast("array<double>").alias("out"))
    nothing = F.array().cast("array<double>")

    def step(acc, _s):
        # try_element_at: a history shorter than the order gives NULL, not an error
        zp = mu + F.aggregate(F.transform(phi, lambda c, i: c * (F.try_element_at(acc.zh, F.size(acc.zh) - i) - mu)),
                              F.lit(0.0), lambda s, v: s + v)
        # undo d differences: each level's last value plus the new value of the level above
        undone = F.aggregate(F.reverse(acc.yl), F.struct(zp.alias("v"), nothing.alias("levels")),
                             lambda s, last: F.struct((last + s.v).alias("v"), F.concat(F.array(last + s.v), s.levels).alias("levels")))
        yp = undone.v
        xp = (yp + F.try_element_at(acc.xh, F.size(acc.xh) - season + 1)) if season else yp
        return F.struct(F.concat(acc.zh, F.array(zp)).alias("zh"), F.concat(acc.xh, F.array(xp)).alias("xh"),
                        undone.levels.alias("yl"), F.concat(acc.out, F.array(xp)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(fh)), init, step).out


def _check_orders(p_values: Sequence[int], d_values: Sequence[int]) -> None:
    if min(p_values) < 0 or min(d_values) < 0:
        raise ValueError("p and d must not be negative")


def _forecast_from(st: DataFrame, season: int, fh: int, series: str) -> DataFrame:
    """``(series, p, d, step, pred)`` from the state of each (series, d) and its order ``p``."""
    # order 0 has no coefficients: the forecast is the mean of the differenced series
    phi = F.when(F.col("p") == 0, F.array().cast("array<double>")).otherwise(F.try_element_at(F.col("_dl"), F.col("p")))
    preds = _ar_path_forecast(phi, F.col("mu"), F.col("zh"), F.col("xh"), F.col("ylast"), season, fh)
    out = st.select(series, "p", "d", F.posexplode(preds).alias("_i", "pred"))
    return out.select(series, "p", "d", (F.col("_i") + 1).alias("step"), "pred")


def ar_forecast(hist: DataFrame, p_values: Sequence[int], d_values: Sequence[int], season: int, fh: int,
                series: str = "series", order: str = "bin", value: str = "value") -> DataFrame:
    """Forecast every (series, p, d) from the end of ``hist``: ``(series, p, d, step, pred)``."""
    _check_orders(p_values, d_values)
    each = hist.withColumn("d", F.explode(F.array(*[F.lit(int(d)) for d in d_values])))
    st = _ar_state(each, max(1, *p_values), max(d_values), season, series, order, value)
    return _forecast_from(st.select("*", F.explode(F.array(*[F.lit(int(p)) for p in p_values])).alias("p")), season, fh, series)


def ar_refit(hist: DataFrame, best: DataFrame, p_max: int, d_max: int, season: int, fh: int,
             series: str = "series", order: str = "bin", value: str = "value") -> DataFrame:
    """Forecast each series with its own chosen order (``best``: series, p, d, one
    row each) refitted on ``hist``: the choice travels with the rows, in one
    plan.  ``p_max``, ``d_max``: the ends of the grid the choice was made from;
    a choice beyond them raises."""
    _check_orders([p_max], [d_max])
    fits = (F.col("p") <= p_max) & (F.col("d") <= d_max)
    chosen = best.select(series, "p", "d").where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("a chosen order lies beyond p_max or d_max")).cast("boolean")))
    st = _ar_state(hist.drop("p", "d").join(chosen, series), max(1, p_max), d_max, season, series, order, value, carry=["p"])
    return _forecast_from(st, season, fh, series)


def _first_fh(long: DataFrame, fh: int, series: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(order)
    return (long.withColumn("step", F.row_number().over(w)).where(F.col("step") <= fh)
                .select(series, "step", F.col(value).cast("double").alias("actual")))


def ar_grid(split_long: DataFrame, p_range: tuple[int, int], d_range: tuple[int, int], season: int = 8,
            fh: int = 8, metric: str = "MSE", series: str = "series", order: str = "bin",
            value: str = "value") -> DataFrame:
    """Score every (series, p, d) on the first ``fh`` validation points after
    fitting on train (M4).  Ranges are half-open like Python ``range``.
    Candidate log ``(series, p, d, cand_idx, loss)``; cand_idx follows the
    loop order p then d."""
    ps, ds = list(range(*p_range)), list(range(*d_range))
    train = split_long.where(F.col("split") == "train")
    val = _first_fh(split_long.where(F.col("split") == "validation"), fh, series, order, value)
    pred = ar_forecast(train, ps, ds, season, fh, series, order, value)
    j = pred.join(val, [series, "step"])
    loss = j.groupBy(series, "p", "d").agg(loss_func(metric)("actual", "pred").alias("loss"))
    return loss.withColumn("cand_idx", (F.col("p") - ps[0]) * len(ds) + (F.col("d") - ds[0]))


def best_of_grid(cands: DataFrame, series: str = "series", loss: str = "loss",
                 cand: str = "cand_idx") -> DataFrame:
    """Lowest loss per series; the earliest candidate wins ties; NULL/NaN never win (M6)."""
    ok = cands.where(F.col(loss).isNotNull() & ~F.isnan(loss))
    w = Window.partitionBy(series).orderBy(F.col(loss), F.col(cand)) if series else \
        Window.partitionBy().orderBy(F.col(loss), F.col(cand))
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ar_holdout(split_long: DataFrame, best: DataFrame, season: int = 8, fh: int = 8,
               metric: str = "MSE", series: str = "series", order: str = "bin",
               value: str = "value", p_range: tuple[int, int] = (1, 4), d_range: tuple[int, int] = (0, 2)) -> DataFrame:
    """Refit each series' chosen (p, d) on train + validation, forecast ``fh``,
    score on the first ``fh`` test points (M5): ``(series, p, d, loss)``.  The
    ranges are those of the grid that ``best`` was chosen from."""
    hist = split_long.where(F.col("split") != "test")
    test = _first_fh(split_long.where(F.col("split") == "test"), fh, series, order, value)
    pred = ar_refit(hist, best, p_range[1] - 1, d_range[1] - 1, season, fh, series, order, value)
    j = pred.join(test, [series, "step"])
    return j.groupBy(series, "p", "d").agg(loss_func(metric)("actual", "pred").alias("loss"))


# ---- M3 --------------------------------------------------------------------------------
def candidate_grid(trees: Sequence[int], depths: Sequence[int]) -> list[tuple[int, int]]:
    """Every forest size with every depth, sizes in the outer order.  Depths over
    30 are refused: the forest library builds none."""
    if any(not 0 <= d <= 30 for d in depths) or any(n < 1 for n in trees):
        raise ValueError("forests need a tree at least and depths of 0 to 30")
    return list(product(trees, depths))


def forest_nodes(model) -> DataFrame:
    """A fitted forest (or any tree ensemble of averages) as a table ``(tree, id, prediction, left, right,
    feature, threshold)``: inner nodes send a row left where ``features[feature]
    <= threshold``, leaves have ``left = -1``; a tree's root has id 0."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"))


def packed_forests(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., forest)``: per forest the array of its trees, a tree an array of
    its nodes in the order of their ids (a forest is as large as the fitted
    model, which its trees' number and depth bound)."""
    node = F.struct("id", "left", "right", "feature", "threshold", "prediction")
    trees = nodes.groupBy(*keys, "tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return trees.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tree", "nodes"))).alias("_t")).select(*keys, F.transform("_t", lambda t: t["nodes"]).alias("forest"))


def forest_predict(forest: Column, features: Column, depth: int) -> Column:
    """The mean of the leaves that ``features`` (array) reaches, one walk of ``depth`` steps a tree."""
    def walk(tree):
        def step(at, _s):
            node = F.element_at(tree, at)
            ahead = F.when(F.element_at(features, node["feature"] + 1) <= node["threshold"], node["left"]).otherwise(node["right"])
            return F.when(node["left"] < 0, at).otherwise(ahead + 1)
        return F.element_at(tree, F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(1), step))["prediction"]
    return _sum(F.transform(forest, walk)) / F.size(forest)


def forest_recursive(rows: DataFrame, fh: int, depth: int, lags_col: str = "lags", forest_col: str = "forest") -> DataFrame:
    """Recursive forecast (M1) with each row's own packed forest, all steps in one
    fold: adds ``step`` (1..fh) and ``pred``, one row per step."""
    init = F.struct(F.col(lags_col).cast("array<double>").alias("lags"), F.array().cast("array<double>").alias("preds"))

    def step(acc, _s):
        pred = forest_predict(F.col(forest_col), acc.lags, depth)
        return F.struct(F.concat(F.slice(acc.lags, F.lit(2), F.size(acc.lags) - 1), F.array(pred)).alias("lags"), F.concat(acc.preds, F.array(pred)).alias("preds"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(fh)), init, step).preds
    out = rows.select("*", F.posexplode(folded).alias("_p", "pred")).drop(forest_col)
    return out.withColumn("step", F.col("_p") + 1).drop("_p")


def rf_grid(train_rows: DataFrame, val_rows: DataFrame, trees: Sequence[int], depths: Sequence[int],
            fh: int, metric: str = "MSE", series: str = "series", seed: int = 1) -> DataFrame:
    """Random-forest grid over (trees, depth), one pooled model per candidate
    fitted on the lag vectors of all series; each scored by a recursive
    forecast over the first ``fh`` validation rows of every series (one
    origin) (M3).  The fitted forests become one table of nodes, and all
    candidates, series and steps are scored in one plan.  Candidate log
    ``(cand_idx, n_trees, depth, loss)``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor
    spark = train_rows.sparkSession
    train = cut_lineage(train_rows.select(array_to_vector("lags").alias("features"), F.col("y").alias("label")), "forest-train")
    w = Window.partitionBy(series).orderBy("row_idx")
    first = val_rows.withColumn("step", F.row_number().over(w)).where(F.col("step") <= fh)
    first = cut_lineage(first.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(series))), "forest-score")
    grid = candidate_grid(trees, depths)
    nodes = None
    for idx, (n, dpt) in enumerate(grid):
        model = RandomForestRegressor(numTrees=n, maxDepth=dpt, seed=seed).fit(train)
        own = forest_nodes(model).withColumn("cand_idx", F.lit(idx))
        nodes = own if nodes is None else nodes.unionByName(own)
    log = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(grid)], "cand_idx int, n_trees int, depth int")
    if nodes is None:
        return log.withColumn("loss", F.lit(None).cast("double"))
    nodes = cut_lineage(nodes, "forest-nodes")
    forests = broadcast_if_small(packed_forests(nodes, ["cand_idx"]), nodes.count() * 64)
    origins = first.where((F.col("step") == 1) & (F.col("_n") >= fh)).select(series, "lags", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("cand_idx"))
    preds = forest_recursive(origins.join(forests, "cand_idx"), fh, max(depths)).select(series, "cand_idx", "step", "pred")
    scored = preds.join(first.select(series, "step", F.col("y").alias("actual")), [series, "step"])
    per_series = scored.groupBy("cand_idx", series).agg(loss_func(metric)("actual", "pred").alias("loss"))
    return log.join(per_series.groupBy("cand_idx").agg(F.avg("loss").alias("loss")), "cand_idx", "left")
