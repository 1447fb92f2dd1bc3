"""Structured Streaming over landed status JSON (S13, ST1-ST5).

* ST1  status stream -> tweet / user / place tables via ``foreachBatch``; each
  micro-batch lands in its own ``batch_id=`` folder (overwritten on replay), so
  a retried batch never appends twice.
* ST2  area-box filter before the sink.
* ST3  running status count (complete-mode aggregate, a version per batch and a
  pointer to the last whole one).
* ST4  one-off catch-up (``availableNow``) or a fixed interval trigger.
* ST5  event-time binning: watermark + ``dropDuplicatesWithinWatermark`` on the
  status id, then a 3-h window count in update mode (latest value per window
  wins when read back).

Checkpoints and outputs go to caller-given paths on shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geo import label_points
from ..session import read_pointer, remove_folders, write_pointer
from ..sources.sinks import append_entities
from ..sources.statuses import parse_statuses, place_rows, tweet_rows, user_rows


WINDOW_FIELDS = ("created_at", "id_str", "coordinates")   # what the window counts read of a status


def status_stream(spark: SparkSession, landing: str, max_files: int | None = None,
                  fields: Sequence[str] | None = None) -> DataFrame:
    """Streaming source: one JSON status per line in the landing folder (S13);
    with ``fields`` only these attributes of it."""
    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return parse_statuses(r.text(landing), fields=fields)


def in_box(statuses: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Keep statuses whose point lies in (sw_lng, sw_lat, ne_lng, ne_lat) (ST2)."""
    sw_lng, sw_lat, ne_lng, ne_lat = box
    lng = F.col("coordinates.coordinates")[0]
    lat = F.col("coordinates.coordinates")[1]
    return statuses.where(lng.between(sw_lng, ne_lng) & lat.between(sw_lat, ne_lat))


def _trigger(writer, trigger: str):
    if trigger == "availableNow":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def run_entity_sink(statuses: DataFrame, out_base: str, checkpoint: str, query_time=None,
                    query_geo: str | None = None, trigger: str = "availableNow"):
    """ST1: append tweet / user / place rows per micro-batch (idempotent by batch id)."""
    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            append_entities({"tweet": tweet_rows(df, query_time, query_geo),
                             "user": user_rows(df, query_time, query_geo),
                             "place": place_rows(df, query_time, query_geo)}, out_base, batch_id)
        finally:
            df.unpersist()
    w = statuses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def run_running_count(statuses: DataFrame, out_path: str, checkpoint: str, trigger: str = "availableNow"):
    """ST3: total statuses so far.  Each batch writes the whole (one-row) result
    as a version of its own and then moves the pointer ``current`` to it, so a
    reader (:func:`read_running_count`) never meets a half-written table, and a
    batch that fails between the two leaves the last total in place.  Versions
    before the last two are removed."""
    counts = statuses.groupBy().agg(F.count(F.lit(1)).alias("statuses"))
    base = out_path.rstrip("/")

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        version = f"version={batch_id:012d}-{uuid.uuid4().hex}"
        df.withColumn("batch_id", F.lit(batch_id)).write.parquet(f"{base}/{version}")
        before = read_pointer(spark, f"{base}/current")
        write_pointer(spark, f"{base}/current", version)
        remove_folders(spark, base, keep={version, before})
    w = counts.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def read_running_count(spark: SparkSession, out_path: str) -> DataFrame:
    """The total of the last batch whose version is complete; no row before the first."""
    base = out_path.rstrip("/")
    version = read_pointer(spark, f"{base}/current")
    if version is None:
        return spark.createDataFrame([], "statuses long, batch_id int")
    return spark.read.parquet(f"{base}/{version}")


def event_time(statuses: DataFrame) -> DataFrame:
    """Instant of ``created_at`` (weekday skipped, offset honoured)."""
    return statuses.withColumn(
        "event_time", F.expr("try_to_timestamp(substring(created_at, 5), 'MMM dd HH:mm:ss Z yyyy')"))


def label_statuses(statuses: DataFrame, polys: DataFrame, out_col: str = "FID_nhood") -> DataFrame:
    """Statuses with the key of the polygon that holds their point (a join of the
    stream with the static polygon cells)."""
    point = F.col("coordinates.coordinates")
    located = statuses.withColumns({"_lng": point[0], "_lat": point[1]})
    return label_points(located, polys, "_lng", "_lat", out_col=out_col).drop("_lng", "_lat")


def dropped_late(query) -> int:
    """Rows a query's stateful operators have dropped as later than the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_window_counts(statuses: DataFrame, out_base: str, checkpoint: str, delay: str, window: str = "3 hours",
                      nhood_col: str | None = None, trigger: str = "availableNow", polys: DataFrame | None = None):
    """ST5: distinct statuses per event-time window, and per neighbourhood if
    ``nhood_col`` is given, de-duplicated within the watermark; update mode; every
    batch's changed windows land in their ``batch_id=`` folder.  The neighbourhood
    is a column of ``statuses``, or with ``polys`` is found here
    (:func:`label_statuses`): then a status that comes again is not located again.
    Statuses more than ``delay`` behind the newest one are dropped
    (:func:`dropped_late` counts them): choose it longer than any landing is late."""
    keys = [nhood_col] if nhood_col else []
    point = F.struct(F.col("coordinates.coordinates").alias("coordinates")).alias("coordinates")
    carried = keys if polys is None else [point]
    ev = (event_time(statuses).select("id_str", "event_time", *carried)
          .withWatermark("event_time", delay)
          .dropDuplicatesWithinWatermark(["id_str"]))
    if polys is not None:
        ev = label_statuses(ev, polys, nhood_col)
    counts = ev.groupBy(F.window("event_time", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))

    def batch(df: DataFrame, batch_id: int) -> None:
        out = df.select(F.timestamp_add("MICROSECOND", F.unix_micros(F.col("w.start")),
                                        F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias("bin"), *keys, "n")
        out.write.mode("overwrite").parquet(f"{out_base.rstrip('/')}/batch_id={batch_id}")
    w = counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def latest_window_counts(spark: SparkSession, out_base: str) -> DataFrame:
    """Read ST5 output back: the last batch's value per window (and neighbourhood)."""
    d = spark.read.parquet(out_base)
    return d.groupBy(*[c for c in d.columns if c not in ("n", "batch_id")]).agg(F.max_by("n", "batch_id").alias("n"))
