"""Per-series analysis on long series ``(series, bin, value)``.

Every window is partitioned by the series key, so one series (bounded by its
time span / bin width, not by the raw data volume) is one window partition;
all lag columns of one analysis share one exchange and one sort.  Windows
without a partition key run only on distinct-bin tables (W8, W9).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def _w(series: str, order: str):
    return Window.partitionBy(series).orderBy(order)


def autocov(long: DataFrame, max_lag: int, series: str = "series", order: str = "bin",
            value: str = "value") -> DataFrame:
    """Per series: n, and S_k = sum_{t>=k} (x_t - mean)(x_{t-k} - mean) for k = 0..max_lag."""
    wall = Window.partitionBy(series)
    w = _w(series, order)
    d = long.withColumn("_xc", F.col(value) - F.avg(value).over(wall))
    d = d.select(series, "_xc", *[F.lag("_xc", k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    return d.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_xc") * F.col("_xc")).alias("s0"),
        *[F.sum(F.col("_xc") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])


def acf(long: DataFrame, max_lag: int, series: str = "series", order: str = "bin",
        value: str = "value") -> DataFrame:
    """Absolute autocorrelation for lags 0..max_lag: ``(series, lag, acf)``.

    r_k = S_k / S_0 (biased); a constant series gives NULL.
    """
    ac = autocov(long, max_lag, series, order, value)
    cols = [F.try_divide(F.col(f"s{k}"), F.col("s0")).alias(str(k)) for k in range(0, max_lag + 1)]
    wide = ac.select(series, *cols)
    long_out = wide.unpivot([series], [str(k) for k in range(0, max_lag + 1)], "lag", "acf")
    return long_out.select(series, F.col("lag").cast("int").alias("lag"), F.abs("acf").alias("acf"))


def durbin_levinson(rho: Column, max_lag: int) -> Column:
    """Fold over lags 1..max_lag on an autocorrelation array ``rho`` (index = lag).

    Returns struct(phi ARRAY<DOUBLE> = AR(max_lag) coefficients, pac ARRAY<DOUBLE> =
    partial autocorrelations for lags 1..max_lag).
    """
    def dot(arr, fn):
        return F.aggregate(F.transform(arr, fn), F.lit(0.0), lambda s, x: s + x)

    init = F.struct(F.array().cast("array<double>").alias("phi"),
                    F.array().cast("array<double>").alias("pac"))

    def step(acc, k):
        phi = acc.phi
        num = rho[k] - dot(phi, lambda p, i: p * rho[k - 1 - i])
        den = F.lit(1.0) - dot(phi, lambda p, i: p * rho[i + 1])
        kk = F.try_divide(num, den)
        new_phi = F.concat(F.transform(phi, lambda p, i: p - kk * phi[k - 2 - i]), F.array(kk))
        return F.struct(new_phi.alias("phi"), F.concat(acc.pac, F.array(kk)).alias("pac"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), init, step)


def pacf(long: DataFrame, max_lag: int, series: str = "series", order: str = "bin",
         value: str = "value") -> DataFrame:
    """Absolute partial autocorrelation, Yule-Walker with n-k denominators,
    lags 0..max_lag: ``(series, lag, pacf)`` (W4)."""
    ac = autocov(long, max_lag, series, order, value)
    g0 = F.col("s0") / F.col("n")
    rho = F.array(*[F.try_divide(F.try_divide(F.col(f"s{k}"), F.col("n") - k), g0) for k in range(0, max_lag + 1)])
    dl = ac.select(series, durbin_levinson(rho, max_lag).alias("_dl"))
    out = dl.select(series, F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("_dl.pac"))).alias("lag", "pacf"))
    return out.select(series, F.col("lag").cast("int").alias("lag"), F.abs("pacf").alias("pacf"))


def best_lag(corr: DataFrame, series: str = "series", value: str = "acf") -> DataFrame:
    """First lag >= 1 with the largest absolute correlation: ``(series, lag, value)``."""
    w = Window.partitionBy(series).orderBy(F.desc(value), F.asc("lag"))
    return (corr.where((F.col("lag") >= 1) & F.col(value).isNotNull())
                .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def decompose(long: DataFrame, period: int, series: str = "series", order: str = "bin",
              value: str = "value") -> DataFrame:
    """Additive seasonal decomposition: observed, trend (centred moving average,
    half weights at the ends for an even period, NULL at the edges), seasonal
    (phase means of the detrended values, centred), residual (W6)."""
    m, h = period, period // 2
    w = _w(series, order)
    x = F.col(value)
    d = long.withColumn("_idx", F.row_number().over(w) - 1)
    # needs two complete periods, like the library it replaces
    d = d.withColumn("_idx", F.when(F.count(F.lit(1)).over(Window.partitionBy(series)) >= 2 * m, F.col("_idx"))
                     .otherwise(F.raise_error(F.lit(f"decompose needs at least {2 * m} observations per series"))
                                .cast("int")))
    win = w.rowsBetween(-h, h)
    lo, hi = F.lag(value, h).over(w), F.lead(value, h).over(w)
    if m % 2 == 0:
        trend = (F.sum(x).over(win) - 0.5 * lo - 0.5 * hi) / m
    else:
        trend = F.sum(x).over(win) / m
    d = d.withColumn("trend", F.when(lo.isNotNull() & hi.isNotNull(), trend))
    d = d.withColumn("_phase", F.col("_idx") % m)
    wp = Window.partitionBy(series, "_phase")
    d = d.withColumn("_pm", F.avg(x - F.col("trend")).over(wp))
    # Mean of the m phase means: the first m rows hold each phase exactly once;
    # summed in phase order so the result does not depend on row arrival.
    ws = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("_pmean", F.avg(F.when(F.col("_idx") < m, F.col("_pm"))).over(ws))
    d = d.withColumn("seasonal", F.col("_pm") - F.col("_pmean"))
    return d.select(series, order, x.alias("observed"), "trend", "seasonal",
                    (x - F.col("trend") - F.col("seasonal")).alias("resid"))


def lag_rows(long: DataFrame, lag: int, series: str = "series", order: str = "bin",
             value: str = "value") -> DataFrame:
    """Sliding window to supervised rows: previous ``lag`` values oldest->newest
    and the target (W7).  ``(series, row_idx, <order>, lags ARRAY<DOUBLE>, y)``."""
    w = _w(series, order)
    d = long.withColumn("lags", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-lag, -1))) \
            .withColumn("_pos", F.row_number().over(w) - 1)
    return d.where(F.size("lags") == lag).select(
        series, (F.col("_pos") - lag).alias("row_idx"), order, "lags", F.col(value).cast("double").alias("y"))


def joint_lag_rows(long: DataFrame, lag: int, series: str = "series", order: str = "bin",
                   value: str = "value") -> DataFrame:
    """Joint supervised rows: at each bin the values of *all* series form one
    vector (series in first-seen order); ``lags`` = the previous ``lag``
    vectors flattened oldest->newest (lag x series features), ``y`` = the
    current vector (W7, joint form).

    A series without a row in some bin has NULL at its place there, so places
    never shift.  The only window without a key numbers the distinct bins; the
    vectors reach the rows they are lags of by an equi-join on that number."""
    idx = cut_lineage(series_index(long, series, order), "series-index")
    places = F.sequence(F.lit(0), F.lit(max(idx.count() - 1, 0)))
    vectors = (long.join(idx, series)
                   .groupBy(order).agg(F.map_from_entries(F.collect_list(F.struct("idx", F.col(value).cast("double")))).alias("_m"))
                   .select(order, F.transform(places, lambda i: F.try_element_at("_m", i.cast(dict(idx.dtypes)["idx"]))).alias("y")))
    numbers = long.select(order).distinct().withColumn("_pos", F.row_number().over(Window.partitionBy().orderBy(order)) - 1)
    rows = cut_lineage(vectors.join(numbers, order), "vectors")
    shifts = F.explode(F.sequence(F.lit(1), F.lit(lag))).alias("_k")
    before = rows.select("_pos", F.col("y").alias("_v"), shifts).select((F.col("_pos") + F.col("_k")).alias("_pos"), F.struct((-F.col("_k")).alias("k"), F.col("_v").alias("v")).alias("_e"))
    hist = before.groupBy("_pos").agg(F.array_sort(F.collect_list("_e")).alias("_hist")).where(F.size("_hist") == lag)
    return rows.join(hist, "_pos").select(
        (F.col("_pos") - lag).alias("row_idx"), order, F.flatten(F.transform("_hist", lambda e: e.v)).alias("lags"), "y")


def _split_sizes(n: Column, test, val) -> tuple[Column, Column]:
    n_test = F.ceil(n * F.lit(float(test))) if isinstance(test, float) else F.lit(int(test))
    remain = n - n_test
    n_val = F.ceil(remain * F.lit(float(val))) if isinstance(val, float) else F.lit(int(val))
    return n_test, n_val


def split_labels(keys: DataFrame, key: str, test, val) -> DataFrame:
    """Chronological train/validation/test label per distinct key (W8/W9 core).

    ``keys`` holds distinct key values; the global window runs on this
    distinct table only.
    """
    wall = Window.partitionBy()
    k = keys.withColumn("_rn", F.row_number().over(Window.partitionBy().orderBy(key))) \
            .withColumn("_n", F.count(F.lit(1)).over(wall))
    n_test, n_val = _split_sizes(F.col("_n"), test, val)
    train_end = F.col("_n") - n_test - n_val
    lab = (F.when(F.col("_rn") > F.col("_n") - n_test, F.lit("test"))
            .when(F.col("_rn") > train_end, F.lit("validation")).otherwise(F.lit("train")))
    return k.select(key, lab.alias("split"))


def ts_split(long: DataFrame, test=0.2, val=0.2, order: str = "bin") -> DataFrame:
    """Split every series on the shared distinct bins (W8): the last part is
    test, the last part of the remainder validation; int sizes or fractions
    (fractions round up)."""
    labels = split_labels(long.select(order).distinct(), order, test, val)
    return long.join(labels, order)


def tabular_split(rows: DataFrame, test=0.2, val=0.2) -> DataFrame:
    """Same rule on supervised rows, by ``row_idx``."""
    labels = split_labels(rows.select("row_idx").distinct(), "row_idx", test, val)
    return rows.join(labels, "row_idx")


def series_index(long: DataFrame, series: str = "series", first_seen: str = "bin") -> DataFrame:
    """Position of each series key (P11): by first appearance, then key."""
    first = long.groupBy(series).agg(F.min(first_seen).alias("_f"))
    w = Window.partitionBy().orderBy("_f", series)
    return first.select(series, (F.row_number().over(w) - 1).alias("idx"))
