"""SURVEY inventory ID -> the registered query that exercises it.

Each ID key is registered in ``queries()`` (and ``oracle_sql()`` when its
query has a SQL twin), so coverage can be read off the driver contract.
"""

ID_QUERIES = {
    # scans, sources, sinks
    "s01_csv_scan": "csv_scan_keep_first", "s02_geojson_scan": "geojson_flatten",
    "s03_boundary_json_to_df": "geojson_flatten", "s04_feature_page_scan": "page_merge",
    "s05_page_merge": "page_merge", "s05_page_keys": "page_keys", "s04_page_errors": "page_merge_dirty", "s06_page_audit": "page_audit", "s06_page_errors": "page_errors", "s07_geometry_audit": "geometry_audit", "s07_polygon_scan": "polygon_scan",
    "s08_clean_reread": "clean_table_roundtrip", "s09_overwrite_sink": "clean_table_roundtrip",
    "s10_append_sink": "stream_statuses_once", "s11_json_sink": "geojson_sink_roundtrip",
    "s12_wide_forecast_scan": "wide_forecast_scan", "s13_status_stream": "stream_statuses_once",
    # projections and scalar functions
    "p01_keep_columns": "clean_calls", "p02_drop_columns": "page_merge", "p03_rename_prefix": "geojson_flatten",
    "p04_flatten_json": "geojson_flatten", "p05_trim": "clean_calls", "p06_thousands": "csv_scan_keep_first",
    "p07_typed_casts": "clean_calls", "p07_call_rejects": "call_rejects", "p08_epoch_to_local": "page_merge", "p09_parse_lnglat": "bbox_filter",
    "p10_key_split": "day_map_frame", "p11_series_index": "series_index", "p12_attention_level": "attention_level",
    "p13_fill_zero": "time_avg", "p14_status_tweet": "status_tweet", "p15_status_user": "status_user",
    "p16_provenance": "status_tweet", "p17_geo_param_text": "radius_match", "p18_day_selector": "day_map_frame",
    # filters
    "f01_time_range": "time_filter", "f02_last_30_days": "last_30_days", "f03_not_null": "clean_calls",
    "f04_category_not_in": "clean_calls", "f05_priority_drop": "clean_calls",
    "f06_source_contains": "clean_posts_two_phase", "f07_row_filter": "box_stats", "f08_nhood_list": "time_count",
    "f09_day_equality": "day_map_frame", "f10_bbox_filter": "bbox_filter", "f11_has_object": "status_place",
    "f12_outside_audit": "outside_audit",
    # joins
    "j01_point_in_polygon": "point_in_polygon", "j02_selective_relabel": "selective_relabel",
    "j03_nhood_nums": "nhood_num_list", "j04_adjacency": "adjacency", "j05_outer_alignment": "working_series",
    "j06_aligned_measures": "attention_level", "j07_forecast_geometry": "day_map_frame",
    "j08_name_reconcile": "name_reconcile", "j09_radius_match": "radius_match",
    # aggregations
    "a01_time_count": "time_count", "a02_time_avg": "time_avg", "a03_gap_grid": "bin_grid_gaps",
    "a05_first_non_null": "first_description", "a06_value_counts": "value_counts",
    "a07_value_shares": "value_shares", "a07_posts_source_shares": "posts_source_shares", "a08_distinct": "distinct_counts", "a09_null_share": "null_share",
    "a10_column_profile": "column_profile", "a11_stage_audit": "stage_audit", "a11_posts_stage_audit": "posts_stage_audit", "a12_box_stats": "box_stats",
    "a13_histogram": "histogram60", "a14_pivot_wide": "wide_series", "a15_unpivot": "unpivot_series",
    "a16_city_total": "city_total", "a16_posts_hourly_total": "posts_hourly_total", "a17_neighbour_total": "neighbour_total",
    "a18_working_series": "working_series", "a19_slice_range": "day_map_frame", "a20_losses": "losses",
    # windows and time series
    "w01_keep_first": "dedupe_keep_first", "w02_two_phase_dedupe": "clean_posts_two_phase", "w02_landed_posts": "landed_posts_clean", "w03_acf": "acf",
    "w04_pacf": "pacf", "w05_best_lag": "best_lag", "w06_decompose": "decompose", "w07_lag_rows": "lag_rows", "w07_joint_lag_rows": "joint_lag_rows",
    "w08_ts_split": "split3", "w09_tabular_split": "tabular_split", "w10_top_per_group": "top10_per_priority",
    "w11_last_n": "last_n_rows", "w11_last_fraction": "last_fraction_rows",
    # sort, limit, union
    "o01_sink_sort": "sink_order", "o02_page_order": "page_order", "o03_top10": "top_categories",
    "o04_newest": "last_rows", "u01_union_files": "csv_scan_keep_first",
    # forecasting
    "m01_recursive_forecast": "recursive_mean_model", "m01_joint_recursive": "joint_recursive_mean", "m01_joint_table": "joint_recursive_table", "m02_model_evaluate": "backtest", "m03_rf_grid": "rf_grid", "m03_forest_scoring": "forest_recursive",
    "m04_ar_grid": "ar_grid", "m04_ar_grid_wide": "ar_grid_wide", "m05_ar_holdout": "ar_holdout", "m06_best_of_grid": "best_of_grid",
    "m07_day_map_frame": "day_map_frame",
    # streaming
    "st1_entity_sink": "stream_statuses_once", "st2_stream_box": "stream_statuses_once",
    "st3_running_count": "stream_total_once", "st4_available_now": "stream_bin_once",
    "st5_stream_bins": "stream_bin_once", "st5_stream_bins_nhood": "stream_bin_nhood",
}

# SURVEY inventory ID -> library function(s) that implement it.
ID_OPERATORS = {
    "s01": "sources.files.read_calls_csv, year_globs, land_calls", "s02": "sources.pages.read_pages, geojson_features",
    "s03": "sources.pages.geojson_features, operators.clean.flatten / strip_prefix",
    "s04": "sources.pages.feature_rows, parsed_pages, good_pages", "s05": "sources.pages.feature_rows (append), page_keys",
    "s06": "sources.pages.page_audit, page_errors", "s07": "operators.geo.polygons_from_table, geometry_reason, geometry_audit, sources.files.read_neighbourhoods_csv",
    "s08": "sources.files.read_clean_table, read_landed_calls", "s09": "sources.sinks.write_table",
    "s10": "sources.sinks.append_entities", "s11": "sources.sinks.write_json_docs",
    "s12": "sources.files.read_wide_forecast", "s13": "streaming.statuses.status_stream",
    "p01": "operators.clean.keep_columns", "p02": "operators.clean.drop_columns",
    "p03": "operators.clean.strip_prefix", "p04": "operators.clean.flatten", "p05": "operators.clean.trim_strings",
    "p06": "functions.text.parse_number", "p07": "functions.casts.checked_timestamp / checked_number, operators.clean.stage_calls / call_reject_audit / rejected_calls",
    "p08": "functions.text.epoch_ms_to_local", "p09": "functions.text.lnglat_from_text",
    "p10": "functions.text.key_compose / key_fid / key_name", "p11": "operators.series.series_index",
    "p12": "operators.bins.attention_level", "p13": "operators.bins.time_groupby (0-fill)",
    "p14": "sources.statuses.tweet_rows", "p15": "sources.statuses.user_rows / place_rows",
    "p16": "sources.statuses.provenance", "p17": "functions.text.geo_param_text / parse_radius_km",
    "p18": "operators.mapframe.day_of / hour_label",
    "f01": "operators.clean.time_range", "f02": "operators.clean.last_days", "f03": "operators.clean.require_not_null",
    "f04": "operators.clean.not_in_keep_null", "f05": "operators.clean.not_in_keep_null",
    "f06": "operators.clean.contains_any", "f07": "DataFrame.where (catalogue box_stats)",
    "f08": "operators.clean.in_list, operators.bins.time_groupby(nhoods=[...])",
    "f09": "operators.mapframe.day_map_frame", "f10": "operators.clean.bbox_filter, streaming.statuses.in_box",
    "f11": "sources.statuses.user_rows / place_rows", "f12": "operators.geo.outside_audit",
    "j01": "operators.geo.label_points", "j02": "operators.geo.relabel", "j03": "operators.geo.nhood_nums",
    "j04": "operators.geo.adjacency", "j05": "operators.bins.working_series", "j06": "operators.bins.count_and_avg",
    "j07": "operators.mapframe.day_map_frame", "j08": "operators.geo.name_reconcile", "j09": "operators.geo.radius_match",
    "a01": "operators.bins.time_groupby(agg='count')", "a02": "operators.bins.time_groupby(agg='avg')",
    "a03": "operators.bins.gap_grid, binned", "a05": "operators.profile.first_non_null",
    "a06": "operators.profile.value_counts", "a07": "operators.profile.value_shares",
    "a08": "operators.profile.distinct_count", "a09": "operators.profile.null_share",
    "a10": "operators.profile.column_profile", "a11": "operators.clean.calls_stage_audit / posts_stage_audit",
    "a12": "operators.profile.box_stats", "a13": "operators.profile.histogram", "a14": "operators.bins.to_wide",
    "a15": "operators.bins.to_long", "a16": "operators.bins.city_total", "a17": "operators.bins.neighbour_total",
    "a18": "operators.bins.working_series", "a19": "operators.mapframe.day_map_frame (zmin, zmax)",
    "a20": "functions.metrics.mae / mse / mape / smape / zero_denominators / loss_func",
    "w01": "operators.clean.keep_first", "w02": "operators.clean.clean_posts, sources.files.read_landed_posts", "w03": "operators.series.acf",
    "w04": "operators.series.pacf, durbin_levinson", "w05": "operators.series.best_lag",
    "w06": "operators.series.decompose", "w07": "operators.series.lag_rows / joint_lag_rows",
    "w08": "operators.series.ts_split", "w09": "operators.series.tabular_split",
    "w10": "operators.profile.top_per_group", "w11": "operators.profile.last_n / last_fraction",
    "o01": "sources.sinks.write_table(sort_by), sources.files.written_order", "o02": "sources.pages.rows_by_id, page_order_audit",
    "o03": "operators.profile.top_values", "o04": "operators.profile.newest", "u01": "sources.files.read_calls_csv (union by name)",
    "m01": "operators.forecast.linear_recursive / linear_recursive_joint / linear_recursive_table / model_recursive / forest_recursive",
    "m02": "operators.forecast.backtest", "m03": "operators.forecast.rf_grid, candidate_grid, forest_nodes, forest_predict",
    "m04": "operators.forecast.ar_grid, ar_forecast", "m05": "operators.forecast.ar_holdout, ar_refit",
    "m06": "operators.forecast.best_of_grid", "m07": "operators.mapframe.day_map_frame",
    "st1": "streaming.statuses.run_entity_sink", "st2": "streaming.statuses.in_box",
    "st3": "streaming.statuses.run_running_count, read_running_count", "st4": "streaming.statuses trigger='availableNow' / interval",
    "st5": "streaming.statuses.run_window_counts, label_statuses, latest_window_counts",
}
