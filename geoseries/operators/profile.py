"""Data profiling.

All are single aggregates with map-side combine; the only windows without a
partition key run on already-aggregated tables (one row per distinct value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .running import ranged, running


def first_non_null(df: DataFrame, group: str, value: str, order: Sequence[str]) -> DataFrame:
    """First non-NULL ``value`` per group in row order (A5)."""
    ordering = F.struct(*[F.col(c) for c in order])
    ok = F.col(value).isNotNull()
    return df.groupBy(group).agg(
        F.min_by(F.when(ok, F.col(value)), F.when(ok, ordering)).alias(value))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, NULLs excluded, largest first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.col(col)))


def value_shares(df: DataFrame, col: str, scale: float = 100.0) -> DataFrame:
    """Count and share of the total per value (A7).  The counts are written once;
    their total (one number) comes from that small table."""
    vc = cut_lineage(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")), "value-counts")
    total = vc.agg(F.sum("count")).first()[0]
    return vc.withColumn("share", F.col("count") * F.lit(scale) / F.lit(total).cast("bigint"))


def distinct_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts of several columns in one pass."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in cols])


def null_share(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """Share of NULLs per column, long ``(column, null_pct)``."""
    wide = df.agg(*[(F.avg(F.col(f"`{c}`").isNull().cast("double")) * scale).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "null_pct")


def column_profile(df: DataFrame) -> DataFrame:
    """Type and non-NULL count per column, plus the row count (A10)."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    types = F.create_map(*[x for f in df.schema.fields
                           for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return (wide.unpivot(["__rows"], df.columns, "column", "non_null")
                .select("column", types[F.col("column")].alias("dtype"), "non_null",
                        F.col("__rows").alias("rows")))


def box_stats(df: DataFrame, group: str, value: str, quantiles: tuple[float, float, float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quartiles (linear interpolation), whiskers (extreme values within
    1.5 IQR of the box) and outlier count per group (A12).

    The input is read once, into counts per (group, value).  Those are ranked by
    running totals over ranges of (group, value) (:mod:`.running`), so one group
    with millions of distinct values spreads over many tasks; the value at a
    rank is the one whose run of equal values covers it.  Whiskers and outliers
    come from the same counts.  NULL values are left out, NULL is a group of its
    own, NaN counts as the largest value.
    """
    v = F.col("_v")
    counts = (df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    counts = running(ranged(counts, [F.col("_g"), v], "value-counts"), ["_g"], [v], {"_upto": ("_c", "sum")})
    counts = cut_lineage(counts, "value-ranks")
    sizes = counts.groupBy("_g").agg(F.sum("_c").alias("n"))
    sizes = sizes.withColumnRenamed("_g", "_h")
    ranked = counts.join(sizes, F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    covers = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in quantiles]
    box = ranked.groupBy("_g").agg(F.max("n").alias("n"), *[F.max(F.when(covers(end(a)), v)).alias(f"_{name}{i}")
                                                         for i, a in enumerate(at) for name, end in (("lo", F.floor), ("hi", F.ceil))])

    def between(i: int) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(lo == hi, lo.cast("double")).otherwise((F.ceil(at[i]) - at[i]) * lo + (at[i] - F.floor(at[i])) * hi)
    box = box.select("_g", "n", *[between(i).alias(name) for i, name in enumerate(("q1", "median", "q3"))])
    iqr = F.col("q3") - F.col("q1")
    fences = box.select(F.col("_g").alias("_h"), (F.col("q1") - 1.5 * iqr).alias("_lo"), (F.col("q3") + 1.5 * iqr).alias("_hi"))
    fenced = counts.join(fences, F.col("_g").eqNullSafe(F.col("_h")))
    whiskers = fenced.groupBy("_h").agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_hi"),
        F.sum(F.when((v < F.col("_lo")) | (v > F.col("_hi")), F.col("_c")).otherwise(0)).alias("outliers"))
    return box.join(whiskers, F.col("_g").eqNullSafe(F.col("_h"))).drop("_h").withColumnRenamed("_g", group)


def histogram(df: DataFrame, value: str, bins: int = 60, below: float | None = 60.0) -> DataFrame:
    """Equal-width histogram over the observed min..max (A13); the top edge
    is inclusive.  Output ``(bucket, lo, hi, count)`` for non-empty buckets."""
    v = F.col(value)
    d = df.where(v.isNotNull())
    if below is not None:
        d = d.where(v < below)
    lo, hi = d.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return d.sparkSession.createDataFrame([], "bucket long, lo double, hi double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.width_bucket(v, F.lit(lo), F.lit(hi if hi > lo else lo + 1.0), F.lit(bins)), F.lit(bins))
    return (d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
             .select("bucket", (F.lit(lo) + (F.col("bucket") - 1) * F.lit(width)).alias("lo"),
                     (F.lit(lo) + F.col("bucket") * F.lit(width)).alias("hi"), "count"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, then in ascending count order (O3)."""
    vc = value_counts(df, col).limit(n)
    return vc.orderBy("count", F.col(col))


def top_per_group(df: DataFrame, group: str, col: str, n: int = 10) -> DataFrame:
    """Top ``n`` values of ``col`` per group with their share of the group."""
    c = df.where(F.col(col).isNotNull()).groupBy(group, col).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(group).orderBy(F.desc("count"), F.col(col))
    return (c.withColumn("rank", F.row_number().over(w))
             .withColumn("share", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(group)))
             .where(F.col("rank") <= n))


def newest(df: DataFrame, ts: str, tie: str, n: int = 5) -> DataFrame:
    """The ``n`` latest rows by timestamp, id as tie-break."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc()).limit(n)


def last_n(df: DataFrame, series: str, order: str, n: int) -> DataFrame:
    """Last ``n`` rows of each series."""
    w = Window.partitionBy(series).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_fraction(df: DataFrame, series: str, order: str, frac: float) -> DataFrame:
    """Last ``int(n * frac)`` rows of each series (W11, fraction form)."""
    w = Window.partitionBy(series).orderBy(F.desc(order))
    wn = Window.partitionBy(series)
    return (df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(wn))
              .where(F.col("_rn") <= F.floor(F.col("_n") * F.lit(frac))).drop("_rn", "_n"))
