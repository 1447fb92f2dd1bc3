"""Fixed-interval binning per neighbourhood.

Canonical output is **long**: one row per (bin, nhood).  The wide table
(one column per neighbourhood) is produced only at the edge by
:func:`to_wide`.

Bin rule: ``bin = d0 + floor((ts - d0) / freq) * freq`` where ``d0`` is
midnight of the neighbourhood's first row.  When ``freq`` divides one day the
origin drops out and bins are aligned for all neighbourhoods, so no extra pass
over the data is needed.

Grid rule: rows are the union over neighbourhoods of their own
[first bin, last bin] runs; every requested neighbourhood gets every grid
bin, 0-filled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clean import in_list
from ..session import DEFAULT_BROADCAST_LIMIT, broadcast_if_small, cut_lineage, drop_staged

DAY_SECONDS = 86400
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

_UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1,
          "t": 60, "min": 60, "minute": 60, "minutes": 60,
          "h": 3600, "hour": 3600, "hours": 3600,
          "d": 86400, "day": 86400, "days": 86400}


def freq_seconds(freq) -> int:
    """``'180Min'``, ``'3H'``, ``'1D'``, ``'3 hours'`` or an int of seconds."""
    if isinstance(freq, int):
        return freq
    m = re.fullmatch(r"\s*(\d+)?\s*([A-Za-z]+)\s*", str(freq))
    if not m or m.group(2).lower() not in _UNITS:
        raise ValueError(f"unsupported frequency {freq!r}")
    return int(m.group(1) or 1) * _UNITS[m.group(2).lower()]


def _step(freq_s: int) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {freq_s})")


def aligned_bin(ts: Column, freq_s: int) -> Column:
    """Bin start for a frequency that divides one day (origin-independent)."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)
    k = F.floor(micros / F.lit(freq_s * 1_000_000))
    return F.timestamp_add("SECOND", k * F.lit(freq_s), F.expr(EPOCH))


def origin_bin(ts: Column, d0: Column, freq_s: int) -> Column:
    """Bin start relative to a per-row origin ``d0``."""
    secs = F.timestamp_diff("MICROSECOND", d0, ts)
    k = F.floor(secs / F.lit(freq_s * 1_000_000))
    return F.timestamp_add("SECOND", k * F.lit(freq_s), d0)


def binned(df: DataFrame, ts_col: str, nhood_col: str, freq, counts: dict[str, str], means: dict[str, str] | None = None) -> DataFrame:
    """``(nhood, bin, counts..., means...)`` of the bins that have rows: exact
    distinct counts (A1) and means (A2) of columns, written once.

    A width that divides a day gives the bin from the time alone.  For any other
    width the rows are first gathered in cells as wide as the greatest common
    divisor of width and day - both the neighbourhood's origin (midnight of its
    first row) and every bin start fall on a cell's start, so origins and bins
    follow from the cells: one pass over the rows, of which only the distinct
    (neighbourhood, cell, counted values) are written.
    """
    fs, means = freq_seconds(freq), means or {}
    ts = F.col(ts_col)
    rows = df.where(F.col(nhood_col).isNotNull() & ts.isNotNull())
    if DAY_SECONDS % fs == 0:
        aggs = [*[F.count_distinct(c).alias(o) for o, c in counts.items()], *[F.avg(c).alias(o) for o, c in means.items()]]
        return cut_lineage(rows.withColumn("bin", aligned_bin(ts, fs)).groupBy(nhood_col, "bin").agg(*aggs), "binned")
    of = {c: f"_v{i}" for i, c in enumerate(dict.fromkeys(counts.values()))}
    sums = [x for o, c in means.items() for x in (F.sum(c).alias(f"_s_{o}"), F.count(c).alias(f"_n_{o}"))] or [F.count(F.lit(1)).alias("_rows")]
    cells = cut_lineage(rows.groupBy(nhood_col, aligned_bin(ts, gcd(fs, DAY_SECONDS)).alias("_cell"), *[F.col(c).alias(v) for c, v in of.items()]).agg(*sums), "cells")
    origins = cut_lineage(cells.groupBy(nhood_col).agg(F.date_trunc("DAY", F.min("_cell")).alias("_d0")), "origins")
    origins = F.broadcast(origins) if origins.count() * 64 <= DEFAULT_BROADCAST_LIMIT else origins
    placed = cells.join(origins, nhood_col).withColumn("bin", origin_bin(F.col("_cell"), F.to_timestamp_ntz(F.col("_d0")), fs))
    aggs = [*[F.count_distinct(of[c]).alias(o) for o, c in counts.items()],
            *[F.try_divide(F.sum(f"_s_{o}"), F.sum(f"_n_{o}")).cast("double").alias(o) for o in means]]
    out = cut_lineage(placed.groupBy(nhood_col, "bin").agg(*aggs), "binned")
    drop_staged(cells)
    return out


def _requested(df: DataFrame, nhood_col: str, nhoods) -> tuple[DataFrame, DataFrame]:
    """Filter rows to the requested neighbourhoods and give the key table."""
    if isinstance(nhoods, str):
        if nhoods != "all":
            raise ValueError("nhoods must be 'all' or a list of keys")
        return df.where(F.col(nhood_col).isNotNull()), None
    keys = list(dict.fromkeys(nhoods))
    spark = df.sparkSession
    key_df = spark.createDataFrame([(k,) for k in keys], f"`{nhood_col}` string")
    return in_list(df, nhood_col, keys), key_df


def gap_grid(present: DataFrame, nhood_col: str, freq, key_df: DataFrame | None = None,
             bin_col: str = "bin") -> DataFrame:
    """Dense (nhood, bin) grid from the (nhood, bin) pairs that have data (A3).

    Grid bins G = union of each neighbourhood's own run first..last.
    The product "every neighbourhood x every bin of G" is formed by an
    equi-join on the calendar day of the bin: each neighbourhood row is
    expanded over the days of the global span (computed on the small
    per-neighbourhood span table), G rows carry their day.
    """
    fs = freq_seconds(freq)
    spans = present.groupBy(nhood_col).agg(F.min(bin_col).alias("_first"),
                                           F.max(bin_col).alias("_last"))
    g = (spans.select(F.explode(F.sequence("_first", "_last", _step(fs))).alias(bin_col))
              .distinct()
              .withColumn("_day", F.to_date(bin_col)))
    keys = spans.select(nhood_col, "_first", "_last") if key_df is None else \
        key_df.join(spans, nhood_col, "left")
    # Global span onto each key row: window without partition over the
    # neighbourhood table only (one row per neighbourhood key).
    w = Window.partitionBy()
    keys = (keys.withColumn("_gmin", F.to_date(F.min("_first").over(w)))
                .withColumn("_gmax", F.to_date(F.max("_last").over(w)))
                .where(F.col("_gmin").isNotNull())
                .select(nhood_col, F.explode(F.sequence("_gmin", "_gmax")).alias("_day")))
    return keys.join(g, "_day").select(bin_col, nhood_col)


def time_groupby(df: DataFrame, col: str, agg: str = "count", nhoods="all",
                 freq="180Min", ts_col: str = "call_timestamp",
                 nhood_col: str = "FID_nhood", value_name: str = "value") -> DataFrame:
    """Distinct count (``agg='count'``) or mean (``'avg'``) of ``col`` per
    (bin, neighbourhood), gap-filled with 0 (A1, A2, A3, P13).

    Long output: ``bin, <nhood_col>, <value_name>``.
    """
    if agg not in ("count", "avg"):
        raise ValueError(f"agg is 'count' or 'avg', not {agg!r}")
    rows, key_df = _requested(df, nhood_col, nhoods)
    # the (nhood, bin) aggregate feeds the grid and the final join; it is written once
    one = {value_name: col}
    present = binned(rows, ts_col, nhood_col, freq, one if agg == "count" else {}, one if agg == "avg" else {})
    grid = gap_grid(present, nhood_col, freq, key_df)
    out = grid.join(present, [nhood_col, "bin"], "left")
    fill = F.lit(0) if agg == "count" else F.lit(0.0)
    return out.select("bin", nhood_col, F.coalesce(F.col(value_name), fill).alias(value_name))


def count_and_avg(df: DataFrame, count_col: str, avg_col: str, nhoods="all", freq="180Min",
                  ts_col: str = "call_timestamp", nhood_col: str = "FID_nhood") -> DataFrame:
    """Both measures in one aggregate (J6: same groups, no join between them)."""
    rows, key_df = _requested(df, nhood_col, nhoods)
    present = binned(rows, ts_col, nhood_col, freq, {"n": count_col}, {"avg_value": avg_col})
    grid = gap_grid(present, nhood_col, freq, key_df)
    return (grid.join(present, [nhood_col, "bin"], "left")
                .select("bin", nhood_col,
                        F.coalesce("n", F.lit(0)).alias("n"),
                        F.coalesce("avg_value", F.lit(0.0)).alias("avg_value")))


def attention_level(df: DataFrame, nhoods="all", freq="180Min", id_col: str = "incident_id",
                    priority_col: str = "priority", ts_col: str = "call_timestamp",
                    nhood_col: str = "FID_nhood") -> DataFrame:
    """``count / (avg_priority + 1) + 1`` per (bin, nhood); empty bin -> 1.0.

    A priority average of exactly -1 gives a zero denominator -> NULL.
    """
    ca = count_and_avg(df, id_col, priority_col, nhoods, freq, ts_col, nhood_col)
    level = F.try_divide(F.col("n").cast("double"), F.col("avg_value") + 1) + 1
    return ca.select("bin", nhood_col, "n", "avg_value", level.alias("att_level"))


def to_wide(long: DataFrame, nhood_col: str = "FID_nhood", value_col: str = "value",
            order: Sequence[str] | None = None) -> DataFrame:
    """Long -> wide, one column per neighbourhood in first-seen order.

    The column list is the neighbourhood key set (bounded by the polygon
    dimension, not by the data volume); without ``order`` it is read from a
    small aggregate (first bin per key, then key).
    """
    if order is None:
        first = long.groupBy(nhood_col).agg(F.min("bin").alias("_f")).orderBy("_f", nhood_col)
        order = [r[0] for r in first.collect()]
    return long.groupBy("bin").pivot(nhood_col, list(order)).agg(F.first(value_col))


def to_long(wide: DataFrame, id_cols: Sequence[str], nhood_col: str = "FID_nhood",
            value_col: str = "value") -> DataFrame:
    """Wide -> long."""
    vals = [c for c in wide.columns if c not in id_cols]
    return wide.unpivot(list(id_cols), vals, nhood_col, value_col)


def city_total(long: DataFrame, value_col: str = "value") -> DataFrame:
    """Sum across all neighbourhoods per bin."""
    return long.groupBy("bin").agg(F.sum(value_col).alias("total"))


def _sized(pairs: DataFrame) -> DataFrame:
    """The staged pair table, broadcast if its text is small."""
    size = pairs.agg(F.sum(F.octet_length("centre") + F.octet_length(F.col(pairs.columns[1])) + 48)).first()[0] or 0
    return broadcast_if_small(pairs, size)


def neighbour_total(long: DataFrame, pairs: DataFrame, nhood_col: str = "FID_nhood",
                    value_col: str = "value") -> DataFrame:
    """Per (bin, centre): sum of the values of the centre's adjacent neighbourhoods.

    ``pairs`` = (centre, neighbour) adjacency table, joined on the neighbour
    key, one pass for all centres; broadcast only if its measured size allows.
    """
    p = _sized(cut_lineage(pairs.select(F.col("centre"), F.col("neighbour").alias(nhood_col)), "pairs"))
    return (long.join(p, nhood_col)
                .groupBy("bin", "centre").agg(F.sum(value_col).alias("adj_total")))


def _spans(rows: DataFrame, nhood_col: str, freq_s: int) -> DataFrame:
    s = rows.groupBy(nhood_col).agg(F.min("bin").alias("_f"), F.max("bin").alias("_l"))
    return s.select(nhood_col, F.explode(F.sequence("_f", "_l", _step(freq_s))).alias("bin"))


def working_series(sources: dict, pairs: DataFrame, freq="180Min",
                   nhood_col: str = "FID_nhood") -> DataFrame:
    """Own and adjacent distinct counts per centre and bin, for every centre.

    ``sources``: label -> (DataFrame, ts column, id column), e.g.
    ``{"calls": (calls, "call_timestamp", "incident_id"),
       "tweets": (posts, "created_at", "id_str"), "users": (posts, "created_at", "user")}``.

    Rows for a centre are the union of the runs of the centre and of each
    adjacent neighbourhood in each source; values are own distinct count and the
    sum of the adjacent neighbourhoods' distinct counts, 0 when absent.  Labels
    that share a DataFrame and time column share one scan and one aggregate.
    """
    fs = freq_seconds(freq)
    # the pair table is small and read by every branch below: write it once
    p = cut_lineage(pairs.select("centre", F.col("neighbour").alias(nhood_col)), "pairs")
    labels = list(sources)
    groups: dict = {}
    for label, (df, ts_col, id_col) in sources.items():
        groups.setdefault((id(df), ts_col), (df, ts_col, []))[2].append((label, id_col))
    values = [c for x in labels for c in (x, x + "_adj")]
    parts = []
    for df, ts_col, members in groups.values():
        counts = binned(df, ts_col, nhood_col, freq, {f"_n_{label}": id_col for label, id_col in members})
        # counts and the empty bins of each run go through one join to all centres they concern: their own and their neighbours'
        empty = _spans(counts, nhood_col, fs).select(nhood_col, "bin", *[F.lit(0).cast("bigint").alias(f"_n_{label}") for label, _ in members])
        own = counts.select(F.col(nhood_col).alias("centre"), nhood_col, F.lit(True).alias("_own")).distinct()
        every = _sized(cut_lineage(p.select("centre", nhood_col, F.lit(False).alias("_own")).unionByName(own), "centres"))
        joined = counts.unionByName(empty).join(every, nhood_col)
        mine = {}
        for label, _ in members:
            n = F.col(f"_n_{label}").cast("bigint")
            mine |= {label: F.when(F.col("_own"), n).otherwise(0), label + "_adj": F.when(F.col("_own"), 0).otherwise(n)}
        parts.append(joined.select("centre", "bin", *[mine.get(v, F.lit(0)).cast("bigint").alias(v) for v in values]))
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.groupBy("centre", "bin").agg(*[F.sum(v).alias(v) for v in values])
