"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's tables (through the stand-ins) and runs the
library's own operators over the whole input.  Output doubles are rounded to
6 decimals and integer counts are BIGINT so results compare exactly with the
SQL twins in :mod:`geoseries.plans.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import metrics as M
from ..functions.text import lnglat_from_text, parse_number, strip_ws
from ..operators import bins, clean, forecast, geo, mapframe, profile, series
from ..session import scratch_path
from ..sources import files, pages, sinks, statuses
from ..streaming import statuses as st
from . import standins as S

RELABEL_NAMES = ["NATION_3"]
FREQ = "3H"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, widen small integers to BIGINT (presentation only)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---- shared pipeline pieces -------------------------------------------------------
def clean_calls_df(spark: SparkSession, sf: str, polys: DataFrame | None = None) -> DataFrame:
    return clean.clean_calls(S.calls_raw(spark, sf), polys if polys is not None else S.polygons(spark, sf), RELABEL_NAMES)


# ---- flagship ------------------------------------------------------------------------
@register("attention_level")
def q_attention_level(spark, sf):
    """Calls -> clean -> 3-h bins per neighbourhood -> gap grid -> attention level."""
    return tidy(bins.attention_level(clean_calls_df(spark, sf), "all", FREQ))


@register("clean_calls")
def q_clean_calls(spark, sf):
    """S1-style raw rows -> filters -> keep-first -> relabel -> drop unlabelled."""
    return tidy(clean_calls_df(spark, sf))


def staged_calls_df(spark, sf):
    return clean.stage_calls(S.calls_raw(spark, sf))


def first_calls_df(spark, sf):
    return clean.keep_first(staged_calls_df(spark, sf), ["incident_id"], clean.ORDER_COLS)


def clean_posts_df(spark, sf, polys=None):
    return clean.clean_posts(S.posts_raw(spark, sf), polys if polys is not None else S.polygons(spark, sf))


def eda_calls_df(spark, sf):
    """Raw calls with the EDA columns typed (all files, no cleaning)."""
    raw = S.calls_raw(spark, sf)
    return raw.select("file_seq", "block_start", "row_seq",
                      strip_ws(F.col("priority")).alias("priority"),
                      strip_ws(F.col("category")).alias("category"),
                      strip_ws(F.col("calldescription")).alias("calldescription"),
                      strip_ws(F.col("officerinitiated")).alias("officerinitiated"),
                      parse_number("dispatchtime", "double").alias("dispatchtime"),
                      parse_number("totalresponsetime", "double").alias("totalresponsetime"))


def post_points_df(spark, sf):
    p = S.posts_raw(spark, sf)
    lng, lat = lnglat_from_text("coordinates")
    return p.select("row_seq", "file_seq", "id_str", "user", "created_at",
                    lng.alias("lng"), lat.alias("lat"))


def centres_df(spark, sf):
    """Search centres ``"lat,long"`` at each polygon's box centre, radius 60 km."""
    p = S.polygons(spark, sf)
    return p.select(F.concat_ws(",", ((F.col("miny") + F.col("maxy")) / 2).cast("string"),
                                ((F.col("minx") + F.col("maxx")) / 2).cast("string")).alias("centre"),
                    F.lit("60km").alias("radius"))


TIME_COUNT_KEYS = ["0,NATION_0", "3,NATION_3", "17,NATION_3", "99,NOWHERE"]


# ---- cleaning ------------------------------------------------------------------------
@register("dedupe_keep_first")
def q_dedupe_keep_first(spark, sf):
    """Keep the first copy per incident_id in (file, row) order after the filters."""
    d = first_calls_df(spark, sf)
    return tidy(d.select("incident_id", "file_seq", "call_timestamp", "priority"))


@register("clean_posts_two_phase")
def q_clean_posts_two_phase(spark, sf):
    """Posts: per-file dedupe -> geo-tag filter -> label -> source filter -> global dedupe."""
    p = clean_posts_df(spark, sf)
    return tidy(p.select("created_at", "id_str", "user", "source", "lng", "lat", "FID_nhood",
                         F.length("text").alias("text_len")))


@register("stage_audit")
def q_stage_audit(spark, sf):
    """Rows per file after each cleaning rule."""
    return tidy(clean.calls_stage_audit(S.calls_raw(spark, sf)))


@register("call_rejects")
def q_call_rejects(spark, sf):
    """Refused casts per file, column and reason, on calls that hold bad texts."""
    return tidy(clean.call_reject_audit(S.calls_dirty(spark, sf)))


@register("rejected_calls")
def q_rejected_calls(spark, sf):
    """The calls with a refused cast, set aside with the reasons."""
    r = clean.rejected_calls(S.calls_dirty(spark, sf))
    why = F.array_join(F.transform("rejects", lambda x: F.concat_ws(":", x["column"], x["reason"])), ",")
    return tidy(r.select("file_seq", "row_seq", why.alias("rejects")))


@register("dirty_clean_calls")
def q_dirty_clean_calls(spark, sf):
    """Cleaned calls of files that hold bad texts: the refused values are NULL, the rows stay."""
    d = clean.keep_first(clean.stage_calls(S.calls_dirty(spark, sf)), ["incident_id"], clean.ORDER_COLS)
    return tidy(d.select("incident_id", "file_seq", "call_timestamp", "priority", "longitude", "latitude"))


# ---- profile -------------------------------------------------------------------------
RAW_CALL_COLS = [*clean.CALL_COLUMNS, "dispatchtime", "totalresponsetime"]


@register("null_share")
def q_null_share(spark, sf):
    """Percent NULL per raw call column."""
    return tidy(profile.null_share(S.calls_raw(spark, sf).select(*RAW_CALL_COLS)))


@register("column_profile")
def q_column_profile(spark, sf):
    """Type and non-NULL count per column of the typed, filtered calls (A10)."""
    return tidy(profile.column_profile(staged_calls_df(spark, sf).drop(*clean.ORDER_COLS)))


@register("value_counts")
def q_value_counts(spark, sf):
    """Calls per category."""
    return tidy(profile.value_counts(clean_calls_df(spark, sf), "category"))


@register("value_shares")
def q_value_shares(spark, sf):
    """Share of calls per priority in percent."""
    return tidy(profile.value_shares(clean_calls_df(spark, sf), "priority"))


@register("top_categories")
def q_top_categories(spark, sf):
    """Ten most frequent categories (O3)."""
    return tidy(profile.top_values(clean_calls_df(spark, sf), "category", 10))


@register("top10_per_priority")
def q_top10_per_priority(spark, sf):
    """Top ten categories per priority with their share."""
    return tidy(profile.top_per_group(clean_calls_df(spark, sf), "priority", "category", 10))


@register("first_description")
def q_first_description(spark, sf):
    """First non-NULL description per category in file/row order (A5)."""
    return tidy(profile.first_non_null(eda_calls_df(spark, sf), "category", "calldescription",
                                       clean.ORDER_COLS))


@register("box_stats")
def q_box_stats(spark, sf):
    """Dispatch-time box statistics per priority for citizen calls."""
    d = eda_calls_df(spark, sf).where((F.col("officerinitiated") == "No") & (F.col("dispatchtime") >= 0))
    return tidy(profile.box_stats(d, "priority", "dispatchtime"))


@register("histogram60")
def q_histogram60(spark, sf):
    """60-bin histogram of total response times under 60."""
    return tidy(profile.histogram(eda_calls_df(spark, sf), "totalresponsetime", 60, 60.0))


@register("last_rows")
def q_last_rows(spark, sf):
    """Five newest cleaned calls."""
    d = clean_calls_df(spark, sf).select("call_timestamp", "incident_id", "FID_nhood")
    return tidy(profile.newest(d, "call_timestamp", "incident_id", 5))


# ---- filters -------------------------------------------------------------------------
@register("time_filter")
def q_time_filter(spark, sf):
    """Calls with 2024-01-10 <= ts < 2024-01-17 (F1)."""
    d = clean.time_range(clean_calls_df(spark, sf), "call_timestamp",
                         "2024-01-10 00:00:00", "2024-01-17 00:00:00")
    return tidy(d.select("incident_id", "call_timestamp", "FID_nhood"))


@register("last_30_days")
def q_last_30_days(spark, sf):
    """Calls in the 30 days before 2024-01-31 (F2)."""
    d = clean.last_days(clean_calls_df(spark, sf), "call_timestamp", "2024-01-31 00:00:00", 30)
    return tidy(d.select("incident_id", "call_timestamp"))


@register("bbox_filter")
def q_bbox_filter(spark, sf):
    """Posts inside the box (1,1)-(9,9)."""
    d = clean.bbox_filter(post_points_df(spark, sf), "lng", "lat", 1.0, 1.0, 9.0, 9.0)
    return tidy(d.select("row_seq", "lng", "lat"))


@register("radius_match")
def q_radius_match(spark, sf):
    """Posts within 60 km of any search centre, one row per (post, centre)."""
    d = geo.radius_match(post_points_df(spark, sf), centres_df(spark, sf))
    return tidy(d.select("row_seq", "centre", "query_geo"))


# ---- binning -------------------------------------------------------------------------
@register("time_count")
def q_time_count(spark, sf):
    """Distinct calls per 3-h bin for a requested neighbourhood list."""
    return tidy(bins.time_groupby(clean_calls_df(spark, sf), "incident_id", "count", TIME_COUNT_KEYS, FREQ))


@register("time_avg")
def q_time_avg(spark, sf):
    """Mean priority per 3-h bin and neighbourhood, empty bins 0 (A2)."""
    return tidy(bins.time_groupby(clean_calls_df(spark, sf), "priority", "avg", "all", FREQ))


@register("bin_grid_gaps")
def q_bin_grid_gaps(spark, sf):
    """5-hour bins: origin = midnight of each neighbourhood's first call; union grid (A3)."""
    return tidy(bins.time_groupby(clean_calls_df(spark, sf), "incident_id", "count", "all", "5H"))


@register("city_total")
def q_city_total(spark, sf):
    """Calls across all neighbourhoods per 3-h bin."""
    long = bins.time_groupby(clean_calls_df(spark, sf), "incident_id", "count", "all", FREQ)
    return tidy(bins.city_total(long))


@register("wide_series")
def q_wide_series(spark, sf):
    """Attention level pivoted to one column per neighbourhood."""
    al = tidy(bins.attention_level(clean_calls_df(spark, sf), "all", FREQ))
    return bins.to_wide(al, "FID_nhood", "att_level", order=S.NHOOD_KEYS)


@register("unpivot_series")
def q_unpivot_series(spark, sf):
    """Wide attention-level table back to long rows."""
    al = tidy(bins.attention_level(clean_calls_df(spark, sf), "all", FREQ))
    wide = bins.to_wide(al, "FID_nhood", "att_level")
    return bins.to_long(wide, ["bin"], "FID_nhood", "att_level")


# ---- geo -----------------------------------------------------------------------------
@register("point_in_polygon")
def q_point_in_polygon(spark, sf):
    """First polygon (file order) containing each call point, boundary included."""
    d = geo.label_points(first_calls_df(spark, sf), S.polygons(spark, sf), "longitude", "latitude", "key")
    return tidy(d.select("incident_id", "key"))


@register("selective_relabel")
def q_selective_relabel(spark, sf):
    """Listed names located by polygon, others by first number of the name."""
    d = geo.relabel(first_calls_df(spark, sf), S.polygons(spark, sf), RELABEL_NAMES)
    return tidy(d.select("incident_id", "neighborhood", "FID_nhood"))


@register("nhood_num_list")
def q_nhood_num_list(spark, sf):
    """All numbers of each block name in file order (J3); many blocks share a name."""
    d = geo.nhood_nums(S.blocks(spark, sf))
    return tidy(d.select("nhood_name", F.concat_ws(",", F.col("nums").cast("array<string>")).alias("nums"),
                         "first_num"))


@register("adjacency")
def q_adjacency(spark, sf):
    """Pairs of city blocks that touch."""
    return tidy(geo.adjacency(S.blocks(spark, sf)).select("centre", "neighbour"))


@register("name_reconcile")
def q_name_reconcile(spark, sf):
    """Names only in boundaries / only in records / shared by several polygons."""
    return tidy(geo.name_reconcile(S.polygons(spark, sf), S.calls_raw(spark, sf)))


@register("outside_audit")
def q_outside_audit(spark, sf):
    """Calls outside the area box, with NULL name, or inside no polygon."""
    return tidy(geo.outside_audit(first_calls_df(spark, sf), S.polygons(spark, sf), "longitude",
                                  "latitude", *S.AREA_BOX))


@register("neighbour_total")
def q_neighbour_total(spark, sf):
    """Per bin and centre: sum of adjacent neighbourhoods' call counts."""
    polys = S.polygons(spark, sf)
    long = bins.time_groupby(clean_calls_df(spark, sf, polys), "incident_id", "count", "all", FREQ)
    pairs = geo.adjacency(polys)
    return tidy(bins.neighbour_total(long, pairs))


@register("working_series")
def q_working_series(spark, sf):
    """Own + adjacent distinct calls, posts and users per centre and bin."""
    polys = S.polygons(spark, sf)
    calls = clean_calls_df(spark, sf, polys)
    posts = clean_posts_df(spark, sf, polys)
    pairs = geo.adjacency(polys)
    srcs = {"calls": (calls, "call_timestamp", "incident_id"),
            "tweets": (posts, "created_at", "id_str"),
            "users": (posts, "created_at", "user")}
    return tidy(bins.working_series(srcs, pairs, FREQ))


# ---- series --------------------------------------------------------------------------
LAG = 3
FH = 8
SEASON = 8
MEAN_WEIGHTS = [1.0 / LAG] * LAG


def series_long(spark, sf):
    """3-h distinct event counts per event type, gap-filled: ``(series, bin, value)``."""
    ev = S.table(spark, sf, "events")
    long = bins.time_groupby(ev, "event_id", "count", "all", FREQ, ts_col="ts", nhood_col="event_type")
    return long.select(F.col("event_type").alias("series"), "bin", F.col("value").cast("double").alias("value"))


def lag_rows_df(spark, sf):
    return series.lag_rows(series_long(spark, sf), LAG)


def _lags_wide(rows):
    return rows.select("series", "row_idx", "bin",
                       *[F.col("lags")[i].alias(f"x_{i + 1}") for i in range(LAG)], "y")


@register("acf")
def q_acf(spark, sf):
    """Absolute autocorrelation, lags 0..8, per series."""
    return tidy(series.acf(series_long(spark, sf), 8))


@register("pacf")
def q_pacf(spark, sf):
    """Absolute partial autocorrelation (Yule-Walker, n-k), lags 0..3."""
    return tidy(series.pacf(series_long(spark, sf), 3))


@register("best_lag")
def q_best_lag(spark, sf):
    """Lag >= 1 with the largest absolute autocorrelation per series."""
    return tidy(series.best_lag(series.acf(series_long(spark, sf), 8)))


@register("decompose")
def q_decompose(spark, sf):
    """Additive decomposition with period 8 (one day of 3-h bins)."""
    return tidy(series.decompose(series_long(spark, sf), SEASON))


@register("lag_rows")
def q_lag_rows(spark, sf):
    """Supervised rows: three previous values and the target."""
    return tidy(_lags_wide(lag_rows_df(spark, sf)))


@register("split3")
def q_split3(spark, sf):
    """Chronological train/validation/test split on shared bins, 0.2 / 0.2."""
    return tidy(series.ts_split(series_long(spark, sf), 0.2, 0.2).select("series", "bin", "split"))


@register("tabular_split")
def q_tabular_split(spark, sf):
    """Same split on supervised rows."""
    return tidy(series.tabular_split(lag_rows_df(spark, sf), 0.2, 0.2).select("series", "row_idx", "split"))


@register("series_index")
def q_series_index(spark, sf):
    """Position of each series by first appearance."""
    return tidy(series.series_index(series_long(spark, sf)))


@register("losses")
def q_losses(spark, sf):
    """MAE, MSE, MAPE, sMAPE of a one-day seasonal-naive forecast per series."""
    s = series_long(spark, sf)
    w = Window.partitionBy("series").orderBy("bin")
    d = s.withColumn("pred", F.lag("value", SEASON).over(w)).where(F.col("pred").isNotNull())
    return tidy(d.groupBy("series").agg(
        M.mae("value", "pred").alias("mae"), M.mse("value", "pred").alias("mse"),
        M.mape("value", "pred").alias("mape"), M.smape("value", "pred").alias("smape"),
        M.zero_denominators("value", "pred").alias("zero_denominators")))


# ---- forecasting ---------------------------------------------------------------------
@register("recursive_mean_model")
def q_recursive_mean_model(spark, sf):
    """8-step recursive forecast of a mean-of-lags model from every supervised row (M1)."""
    rows = lag_rows_df(spark, sf)
    return tidy(forecast.linear_recursive(rows, MEAN_WEIGHTS, 0.0, FH).select("series", "row_idx", "step", "pred"))


@register("forest_recursive")
def q_forest_recursive(spark, sf):
    """8-step recursive forecast of a forest a series, given as a table of nodes (three trees
    that split at the mean of its values), from every supervised row (M1, M3's scoring half)."""
    long = series_long(spark, sf)
    mean, low, high = F.round(F.avg("value"), 3), F.min("value"), F.max("value")
    inner = lambda i, left, feature, threshold: (i, left, left + 1, feature, threshold, F.lit(0.0))
    leaf = lambda i, prediction: (i, -1, -1, -1, F.lit(0.0), prediction)
    trees = [(t, [inner(0, 1, t, F.col("a")), leaf(1, F.col("lo")), inner(2, 3, (t + 1) % LAG, F.col("a") * 1.2), leaf(3, F.col("a")), leaf(4, F.col("hi"))]) for t in range(LAG)]
    rows = F.array(*[F.struct(F.lit(t).alias("tree"), *[(F.lit(x) if isinstance(x, int) else x).alias(n) for n, x in
                                                        zip(("id", "left", "right", "feature", "threshold", "prediction"), node, strict=True)])
                     for t, nodes in trees for node in nodes])
    nodes = long.groupBy("series").agg(mean.alias("a"), low.alias("lo"), high.alias("hi")).select("series", F.inline(rows))
    out = forecast.forest_recursive(lag_rows_df(spark, sf).join(forecast.packed_forests(nodes, ["series"]), "series"), FH, 2)
    return tidy(out.select("series", "row_idx", "step", "pred"))


def _test_rows(spark, sf):
    return series.tabular_split(lag_rows_df(spark, sf), 0.2, 0.2).where(F.col("split") == "test")


@register("backtest")
def q_backtest(spark, sf):
    """Mean MSE over every 8-step origin of the test rows, mean-of-lags model (M2)."""
    pred = lambda o: forecast.linear_recursive(o, MEAN_WEIGHTS, 0.0, FH)
    return tidy(forecast.backtest(_test_rows(spark, sf), FH, pred, "MSE"))


def _ar_split(spark, sf):
    return series.ts_split(series_long(spark, sf), 0.2, 0.2)


@register("ar_grid")
def q_ar_grid(spark, sf):
    """Seasonal-AR candidates p in 1..3, d in 0..1, season 8, scored on 8 validation steps (M4)."""
    return tidy(forecast.ar_grid(_ar_split(spark, sf), (1, 4), (0, 2), SEASON, FH, "MSE"))


@register("ar_grid_wide")
def q_ar_grid_wide(spark, sf):
    """The order grid at p = 0 and 1 and d = 0 to 2 (M4)."""
    split = series.ts_split(series_long(spark, sf), 0.2, 0.2)
    return tidy(forecast.ar_grid(split, (0, 2), (0, 3), SEASON, FH))


@register("best_of_grid")
def q_best_of_grid(spark, sf):
    """Best AR candidate per series, earliest wins ties (M6)."""
    return tidy(forecast.best_of_grid(forecast.ar_grid(_ar_split(spark, sf), (1, 4), (0, 2), SEASON, FH)))


@register("ar_holdout")
def q_ar_holdout(spark, sf):
    """Chosen AR order refitted on train+validation, scored on 8 test steps (M5)."""
    split = _ar_split(spark, sf)
    best = forecast.best_of_grid(forecast.ar_grid(split, (1, 4), (0, 2), SEASON, FH))
    return tidy(forecast.ar_holdout(split, best, SEASON, FH))


@register("rf_grid")
def q_rf_grid(spark, sf):
    """Random-forest grid (trees 50, 100; depths 1, 3) on lag rows, recursive 8-step score (M3)."""
    rows = series.tabular_split(lag_rows_df(spark, sf), 0.2, 0.2)
    train = rows.where(F.col("split") == "train")
    val = rows.where(F.col("split") == "validation")
    return tidy(forecast.rf_grid(train, val, [50, 100], [1, 3], FH, "MSE"))


# ---- map frame -----------------------------------------------------------------------
MAP_DATE = "2024-01-15"


@register("day_map_frame")
def q_day_map_frame(spark, sf):
    """Wide attention-level table -> one day's long frame with colour range, label, polygon (M7)."""
    polys = S.polygons(spark, sf)
    al = tidy(bins.attention_level(clean_calls_df(spark, sf, polys), "all", FREQ))
    wide = bins.to_wide(al, "FID_nhood", "att_level")
    wide = wide.withColumn("Day", F.dayofmonth("bin")).withColumn("Hour", F.hour("bin")).drop("bin")
    out = mapframe.day_map_frame(wide, mapframe.day_of(MAP_DATE), polys)
    return tidy(out.drop("nhood"))


# ---- landed pages and statuses -------------------------------------------------------
CALL_ATTRS = T.StructType([T.StructField("incident_id", T.LongType()),
                            T.StructField("call_timestamp", T.LongType()),
                            T.StructField("category", T.StringType()),
                            T.StructField("priority", T.StringType())])
NHOOD_PROPS = T.StructType([T.StructField("FID", T.LongType()), T.StructField("nhood_name", T.StringType())])
QUERY_TIME = "2024-02-01 00:00:00"
QUERY_GEO = "5.0,5.0,60km"


@register("page_merge")
def q_page_merge(spark, sf):
    """Landed REST pages -> one row per record, epoch ms -> local time."""
    rows = pages.feature_rows(S.call_pages(spark, sf), CALL_ATTRS)
    return tidy(rows)


@register("page_audit")
def q_page_audit(spark, sf):
    """Rows, more-rows flag, next offset and flag consistency per page."""
    return tidy(pages.page_audit(S.call_pages(spark, sf), pages.feature_page_schema(CALL_ATTRS)))


@register("page_errors")
def q_page_errors(spark, sf):
    """Pages, rows and page range per class of landed page, on a feed with errors."""
    return tidy(pages.page_errors(S.call_pages_dirty(spark, sf), pages.feature_page_schema(CALL_ATTRS)))


@register("page_audit_dirty")
def q_page_audit_dirty(spark, sf):
    """The page audit of a feed with errors: class, rows and consistency per page."""
    return tidy(pages.page_audit(S.call_pages_dirty(spark, sf), pages.feature_page_schema(CALL_ATTRS)))


@register("page_merge_dirty")
def q_page_merge_dirty(spark, sf):
    """The records of the usable pages of a feed with errors."""
    return tidy(pages.feature_rows(S.call_pages_dirty(spark, sf), CALL_ATTRS, on_bad="drop"))


@register("page_keys")
def q_page_keys(spark, sf):
    """Keys of the pages besides their features, later pages over earlier ones."""
    schema = T.StructType([*pages.feature_page_schema(CALL_ATTRS).fields, T.StructField("error", pages.ERROR), T.StructField("status", T.StringType())])
    k = pages.page_keys(S.call_pages_dirty(spark, sf), schema)
    return tidy(k.select("exceededTransferLimit", F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"), "status"))


@register("page_order")
def q_page_order(spark, sf):
    """City-block pages: ascending by id inside and over the pages (O2)."""
    feats = pages.geojson_features(S.boundary_pages(spark, sf), NHOOD_PROPS)
    return tidy(pages.page_order_audit(feats, "FID"))


@register("geometry_audit")
def q_geometry_audit(spark, sf):
    """Block table with bad geometries: rows per reason."""
    return tidy(geo.geometry_audit(S.block_table_dirty(spark, sf), type_col="geometry.type"))


@register("geojson_flatten")
def q_geojson_flatten(spark, sf):
    """City-block GeoJSON pages -> flattened features (S2, S3, P4) -> polygons."""
    feats = pages.geojson_features(S.boundary_pages(spark, sf), NHOOD_PROPS)
    polys = geo.polygons_from_table(feats, "FID", "nhood_name", "geometry.coordinates", "FID", "geometry.type")
    return tidy(feats.join(polys.select(F.col("nhood_num").alias("FID"), "key", F.size("ring").alias("n_points"),
                                        "minx", "miny", "maxx", "maxy"), "FID")
                     .select("page_no", "feature_pos", "FID", "nhood_name",
                             F.col("`geometry.type`").alias("geometry_type"), "key", "n_points",
                             "minx", "miny", "maxx", "maxy"))


def _statuses(spark, sf):
    return statuses.parse_statuses(S.status_docs(spark, sf))


@register("status_tweet")
def q_status_tweet(spark, sf):
    """Status -> tweet rows with provenance."""
    t = statuses.tweet_rows(_statuses(spark, sf), QUERY_TIME, QUERY_GEO)
    return tidy(t.withColumn("has_place", F.col("place").isNotNull()).drop("place"))


@register("status_user")
def q_status_user(spark, sf):
    """Status -> author rows where the author is present."""
    return tidy(statuses.user_rows(_statuses(spark, sf), QUERY_TIME, QUERY_GEO))


@register("status_place")
def q_status_place(spark, sf):
    """Status -> place rows where the place is present."""
    p = statuses.place_rows(_statuses(spark, sf), QUERY_TIME, QUERY_GEO)
    return tidy(p.withColumn("box_points", F.size(F.col("bounding_box.coordinates")[0])).drop("bounding_box"))


# ---- streaming -----------------------------------------------------------------------
STREAM_BOX = S.AREA_BOX


LANDED_ROWS = 25_000    # statuses per landed file: a compressed file is read by one task
LANDED_BATCHES = 4      # micro-batches the landed files come in


def _land_statuses(spark, sf):
    """Land the status documents twice (a replayed feed) in a fresh folder on the
    shared checkpoint storage; returns the folder.  The documents are made once and
    land compressed from the tasks that make them, without a shuffle of their texts;
    the replay lands a copy of the landed files' lines."""
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    landing = f"{base}/landing"
    how = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": LANDED_ROWS}
    S.status_docs(spark, sf).select("value").write.options(**how).text(landing)
    spark.read.text(landing).write.options(**how).mode("append").text(landing)
    return base


def _stream_statuses(spark, base, fields=None):
    landed = len(spark.read.text(f"{base}/landing").inputFiles())
    return st.in_box(st.status_stream(spark, f"{base}/landing", max(1, -(-landed // LANDED_BATCHES)), fields), STREAM_BOX)


@register("stream_statuses_once")
def q_stream_statuses_once(spark, sf):
    """Replayed status feed -> box filter -> tweet table via foreachBatch, one-off run (ST1, ST2, ST4, S10)."""
    base = _land_statuses(spark, sf)
    q = st.run_entity_sink(_stream_statuses(spark, base), f"{base}/out", f"{base}/ckpt_entities",
                           QUERY_TIME, QUERY_GEO)
    q.awaitTermination()
    t = spark.read.parquet(f"{base}/out/tweet").drop("batch_id")
    return tidy(t.withColumn("has_place", F.col("place").isNotNull()).drop("place"))


@register("landed_posts_clean")
def q_landed_posts_clean(spark, sf):
    """Replayed status feed -> entity tables -> read back as posts -> two-phase
    de-duplication, polygons, sources (entry B: ST1, W2, J1, F6)."""
    base = _land_statuses(spark, sf)
    st.run_entity_sink(_stream_statuses(spark, base), f"{base}/out", f"{base}/ckpt_entities", QUERY_TIME, QUERY_GEO).awaitTermination()
    posts = clean.clean_posts(files.read_landed_posts(spark, f"{base}/out/tweet"), S.polygons(spark, sf))
    return tidy(posts.select("created_at", "id_str", "user", "lng", "lat", "FID_nhood"))


@register("stream_total_once")
def q_stream_total_once(spark, sf):
    """Running count of statuses received inside the box (ST3)."""
    base = _land_statuses(spark, sf)
    q = st.run_running_count(_stream_statuses(spark, base, ["coordinates"]), f"{base}/total", f"{base}/ckpt_total")
    q.awaitTermination()
    return tidy(st.read_running_count(spark, f"{base}/total").select("statuses"))


@register("stream_bin_once")
def q_stream_bin_once(spark, sf):
    """Distinct statuses per 3-h event-time window, deduplicated within the watermark (ST5)."""
    base = _land_statuses(spark, sf)
    q = st.run_window_counts(_stream_statuses(spark, base, st.WINDOW_FIELDS), f"{base}/bins", f"{base}/ckpt_bins", delay="60 days")
    q.awaitTermination()
    return tidy(st.latest_window_counts(spark, f"{base}/bins"))


@register("stream_bin_nhood")
def q_stream_bin_nhood(spark, sf):
    """Distinct statuses per 3-h event-time window and neighbourhood (ST5, J1 on the stream)."""
    base = _land_statuses(spark, sf)
    q = st.run_window_counts(_stream_statuses(spark, base, st.WINDOW_FIELDS), f"{base}/bins", f"{base}/ckpt_bins", delay="60 days",
                             nhood_col="FID_nhood", polys=S.polygons(spark, sf))
    q.awaitTermination()
    return tidy(st.latest_window_counts(spark, f"{base}/bins"))


# ---- file round trips (S1, S7, S8, S9, S11, S12, O1) ----------------------------------
def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("csv_scan_keep_first")
def q_csv_scan_keep_first(spark, sf):
    """Raw calls landed as one CSV folder per file, scanned back by a glob list
    (all STRING, file order captured at the scan), then staged and kept-first (S1, U1, W1)."""
    base = _scratch(spark, "calls-csv")
    raw = S.calls_raw(spark, sf)
    cols = [c for c in raw.columns if c not in clean.ORDER_COLS]
    for seq in (1, 2):
        (raw.where(F.col("file_seq") == seq).orderBy("row_seq").select(*cols)
            .write.mode("overwrite").option("header", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{base}/year{seq}"))
    scanned = files.read_calls_csv(spark, [f"{base}/year1/*.csv", f"{base}/year2/*.csv"])
    first = clean.keep_first(clean.stage_calls(scanned), ["incident_id"], clean.ORDER_COLS)
    return tidy(first.select("incident_id", "call_timestamp", "priority"))


@register("polygon_scan")
def q_polygon_scan(spark, sf):
    """Block boundary CSV (coordinates as text) -> polygons: key, position, ring, box."""
    path = _scratch(spark, "blocks-csv")
    S.block_table(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    p = files.read_neighbourhoods_csv(spark, path)
    return tidy(p.select("key", "nhood_num", "nhood_name", F.size("ring").alias("n_points"),
                         "minx", "miny", "maxx", "maxy", "valid"))


@register("clean_table_roundtrip")
def q_clean_table_roundtrip(spark, sf):
    """Cleaned calls written sorted by time (O1, S9) and re-read typed."""
    path = _scratch(spark, "calls-clean")
    sinks.write_table(clean_calls_df(spark, sf), path, "parquet", sort_by=("call_timestamp", "incident_id"))
    return tidy(files.read_clean_table(spark, path, "call_timestamp"))


@register("sink_order")
def q_sink_order(spark, sf):
    """Cleaned calls written sorted by time: the place of every row in the written files (O1)."""
    path = _scratch(spark, "calls-sorted")
    sinks.write_table(clean_calls_df(spark, sf), path, "parquet", sort_by=("call_timestamp", "incident_id"))
    return tidy(files.written_order(spark, path).select("position", "incident_id", "call_timestamp"))


@register("geojson_sink_roundtrip")
def q_geojson_sink_roundtrip(spark, sf):
    """City-block boundary pages written as JSON documents (S11) and scanned back as GeoJSON."""
    path = _scratch(spark, "geojson")
    sinks.write_json_docs(S.boundary_pages(spark, sf).select("text"), path, "text")
    feats = pages.geojson_features(pages.read_pages(spark, path, lines=True), NHOOD_PROPS)
    return tidy(feats.select("FID", "nhood_name", F.col("`geometry.type`").alias("geometry_type")))


@register("wide_forecast_scan")
def q_wide_forecast_scan(spark, sf):
    """Wide attention-level table landed as CSV, scanned back (S12) and turned into the day frame (M7)."""
    path = _scratch(spark, "wide-csv")
    al = tidy(bins.attention_level(clean_calls_df(spark, sf), "all", FREQ))
    wide = bins.to_wide(al, "FID_nhood", "att_level")
    wide = wide.withColumn("Day", F.dayofmonth("bin")).withColumn("Hour", F.hour("bin")).drop("bin")
    wide.write.mode("overwrite").option("header", True).csv(path)
    back = files.read_wide_forecast(spark, path)
    out = mapframe.day_map_frame(back, mapframe.day_of(MAP_DATE), S.polygons(spark, sf))
    return tidy(out.drop("nhood"))


@register("distinct_counts")
def q_distinct_counts(spark, sf):
    """Exact distinct categories, neighbourhoods and incidents of the cleaned calls."""
    return tidy(profile.distinct_count(clean_calls_df(spark, sf), ["category", "FID_nhood", "incident_id"]))


@register("last_n_rows")
def q_last_n_rows(spark, sf):
    """Last 160 bins of every series."""
    return tidy(profile.last_n(series_long(spark, sf), "series", "bin", 160))


@register("last_fraction_rows")
def q_last_fraction_rows(spark, sf):
    """Last quarter (int(n * 0.25) bins) of every series (W11, fraction form)."""
    return tidy(profile.last_fraction(series_long(spark, sf), "series", "bin", 0.25))


@register("posts_stage_audit")
def q_posts_stage_audit(spark, sf):
    """Posts per file: raw, unique ids, geo-tagged, inside a polygon, kept by source."""
    return tidy(clean.posts_stage_audit(S.posts_raw(spark, sf), S.polygons(spark, sf)))


@register("joint_lag_rows")
def q_joint_lag_rows(spark, sf):
    """Joint supervised rows over all series (three previous vectors -> current vector),
    exploded to (row, part, position, value) (W7 joint form)."""
    r = series.joint_lag_rows(series_long(spark, sf), LAG)
    xs = r.select("row_idx", "bin", F.lit("x").alias("part"), F.posexplode("lags").alias("pos", "value"))
    ys = r.select("row_idx", "bin", F.lit("y").alias("part"), F.posexplode("y").alias("pos", "value"))
    return tidy(xs.unionByName(ys))


@register("joint_recursive_mean")
def q_joint_recursive_mean(spark, sf):
    """8-step joint recursive forecast over all series at once: each series'
    prediction is the mean of its own three previous values, the whole vector is
    appended each step (M1, all-series form)."""
    long = series_long(spark, sf)
    k = long.select("series").distinct().count()
    idx = series.series_index(long)
    rows = series.joint_lag_rows(long, LAG)
    weights = [[(1.0 / LAG if i % k == j else 0.0) for i in range(LAG * k)] for j in range(k)]
    out = forecast.linear_recursive_joint(rows, weights, [0.0] * k, FH)
    out = out.join(idx, out["series_pos"] == idx["idx"]).select("series", "row_idx", "step", "pred")
    return tidy(out)


@register("joint_recursive_table")
def q_joint_recursive_table(spark, sf):
    """The joint recursive forecast with the model as a table (M1, all-series form)."""
    long = series_long(spark, sf)
    idx = series.series_index(long)
    k = idx.count()
    rows = series.joint_lag_rows(long, LAG)
    weights = [[(1.0 / LAG if i % k == j else 0.0) for i in range(LAG * k)] for j in range(k)]
    out = forecast.linear_recursive_table(rows, forecast.weight_table(weights, [0.0] * k, spark), k, FH, ["row_idx"])
    return tidy(out.join(idx, out["series_pos"] == idx["idx"]).select("series", "row_idx", "step", "pred"))


@register("posts_source_shares")
def q_posts_source_shares(spark, sf):
    """Share of cleaned posts per source application (A7 on the posts table)."""
    return tidy(profile.value_shares(clean_posts_df(spark, sf), "source"))


@register("posts_hourly_total")
def q_posts_hourly_total(spark, sf):
    """Distinct posts per neighbourhood and hour, then the citywide hourly total."""
    long = bins.time_groupby(clean_posts_df(spark, sf), "id_str", "count", "all", "1H", ts_col="created_at")
    return tidy(bins.city_total(long))
