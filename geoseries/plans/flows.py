"""End-to-end flows for the three entry points, built from the
library's operators.

* :func:`calls_to_attention` - call CSVs + neighbourhood CSV -> cleaned calls
  and the attention-level table, both written (entry A).
* :func:`statuses_to_tables` - landed status JSON -> tweet / user / place
  tables through Structured Streaming, :func:`landed_to_working_series` - those
  tables -> cleaned posts -> working series with the calls (entry B).
* :func:`forecast_table` - a binned series -> AR order search on
  train/validation, refit on train+validation, forecast of the next ``fh``
  bins as a wide table with ``Day`` and ``Hour`` (entry C, the map's input).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bins, clean, forecast, geo, series
from ..sources import files, sinks
from ..streaming import statuses as st


def calls_to_attention(spark: SparkSession, call_globs: Sequence[str], nhood_csv: str, out_dir: str,
                       relabel_names: Sequence[str] = (), freq="180Min", fmt: str = "parquet",
                       strict: bool = False) -> DataFrame:
    """Scan -> clean -> keep first -> relabel -> write cleaned calls (sorted) ->
    bin -> attention level -> write.  Returns the written attention table.

    A text that its column's type refuses fails the flow if ``strict``;
    otherwise its value is NULL and the row goes to ``calls_rejected`` beside
    the cleaned calls, with the reasons."""
    polys = files.read_neighbourhoods_csv(spark, nhood_csv)
    raw = files.read_calls_csv(spark, list(call_globs))
    calls = clean.clean_calls(raw, polys, list(relabel_names), on_reject="raise" if strict else "null")
    if not strict:
        sinks.write_table(clean.rejected_calls(raw), f"{out_dir}/calls_rejected", "parquet")
    sinks.write_table(calls, f"{out_dir}/calls_clean", fmt, sort_by=("call_timestamp", "incident_id"))
    cleaned = files.read_clean_table(spark, f"{out_dir}/calls_clean", "call_timestamp", fmt)
    level = bins.attention_level(cleaned, "all", freq)
    sinks.write_table(level, f"{out_dir}/attention_level", fmt)
    return spark.read.format(fmt).load(f"{out_dir}/attention_level")


def statuses_to_tables(spark: SparkSession, landing: str, out_dir: str, box=None, query_geo: str | None = None,
                       trigger: str = "availableNow") -> dict[str, DataFrame]:
    """Landed status JSON -> (box filter) -> tweet / user / place tables."""
    stream = st.status_stream(spark, landing)
    if box is not None:
        stream = st.in_box(stream, box)
    q = st.run_entity_sink(stream, f"{out_dir}/tables", f"{out_dir}/_checkpoint", None, query_geo, trigger)
    if trigger == "availableNow":
        q.awaitTermination()
    return {n: spark.read.parquet(f"{out_dir}/tables/{n}") for n in ("tweet", "user", "place")}


def landed_to_working_series(spark: SparkSession, tables: str, calls: DataFrame, polys: DataFrame, out_dir: str,
                             freq="180Min", fmt: str = "parquet") -> DataFrame:
    """Entity tables of :func:`statuses_to_tables` (their folder) -> cleaned posts
    (two-phase de-duplication, written sorted) -> working series of calls,
    posts and authors for every neighbourhood and its neighbours (A18)."""
    posts = clean.clean_posts(files.read_landed_posts(spark, f"{tables}/tweet"), polys)
    sinks.write_table(posts, f"{out_dir}/posts_clean", fmt, sort_by=("created_at", "id_str"))
    posts = files.read_clean_table(spark, f"{out_dir}/posts_clean", "created_at", fmt)
    return bins.working_series({"calls": (calls, "call_timestamp", "incident_id"), "tweets": (posts, "created_at", "id_str"),
                                "users": (posts, "created_at", "user")}, geo.adjacency(polys), freq)


def forecast_table(long: DataFrame, freq="180Min", fh: int = 8, season: int = 8,
                   p_range=(1, 4), d_range=(0, 2), test=0.2, val=0.2, series_col: str = "series",
                   value: str = "value") -> DataFrame:
    """Order search per series (M4, M6), refit on train+validation and forecast
    the ``fh`` bins after the history (M5's refit, without scoring), pivoted
    to one column per series with ``Day`` and ``Hour`` of each forecast bin."""
    fs = bins.freq_seconds(freq)
    split = series.ts_split(long.withColumnRenamed(series_col, "series").withColumnRenamed(value, "value"),
                            test, val)
    best = forecast.best_of_grid(forecast.ar_grid(split, p_range, d_range, season, fh))
    hist = split.where(F.col("split") != "test")
    pred = forecast.ar_refit(hist, best, p_range[1] - 1, d_range[1] - 1, season, fh)
    last = hist.groupBy("series").agg(F.max("bin").alias("_last"))
    pred = pred.join(last, "series").withColumn(
        "bin", F.timestamp_add("SECOND", F.col("step") * F.lit(fs), F.col("_last")))
    wide = bins.to_wide(pred.select("bin", "series", F.col("pred").alias("value")), "series", "value")
    return wide.withColumn("Day", F.dayofmonth("bin")).withColumn("Hour", F.hour("bin")).drop("bin")
