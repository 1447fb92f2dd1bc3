"""Forecast-for-a-day frame behind the choropleth.

Input: a wide forecast table, one column per ``"FID,name"`` neighbourhood plus
``Day`` and ``Hour``.  Output: one long row per (hour, neighbourhood) of the
chosen day with FID, name, value, the day's colour range, the slider label
and the matching polygon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_fid, key_name
from .geo import polygon_stats
from ..session import DEFAULT_BROADCAST_LIMIT


def day_of(date_text: str) -> int:
    """Day of month of an ISO date text."""
    return int(date_text[8:10])


def hour_label(hour) -> F.Column:
    """Slider label ``Hour h:00``."""
    return F.format_string("Hour %d:00", F.col(hour) if isinstance(hour, str) else hour)


def day_map_frame(wide: DataFrame, day: int, polys: DataFrame,
                  id_cols: Sequence[str] = ("Day", "Hour"), value: str = "att_level") -> DataFrame:
    """Filter the day (F9), unpivot (A15), split the key (P10), colour range of
    the day (A19), label (P18), join the polygon on FID (J7)."""
    vals = [c for c in wide.columns if c not in id_cols]
    d = wide.where(F.col("Day") == day)
    long = d.unpivot(list(id_cols), vals, "nhood", value)
    long = long.withColumn("FID", key_fid("nhood")).withColumn("name", key_name("nhood"))
    rng = long.groupBy("Day").agg(F.min(value).alias("zmin"), F.max(value).alias("zmax"))
    long = long.join(rng, "Day").withColumn("label", hour_label("Hour"))
    geo = polys.select(F.col("nhood_num").cast("int").alias("FID"), F.col("ring"))
    stats = polygon_stats(polys)
    geo = F.broadcast(geo) if stats["est_bytes"] <= DEFAULT_BROADCAST_LIMIT else geo
    return long.join(geo, "FID", "left").withColumn("has_geometry", F.col("ring").isNotNull()).drop("ring")
