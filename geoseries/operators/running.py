"""Running totals over tables of any size, whatever share of the rows a key holds.

The table is range-partitioned by (keys, order) and written once; totals run
inside each range, and each range gets the totals that its first key has
gathered in earlier ranges.  So a key that holds a third of all rows is spread
over many tasks, and only one row a range (its first key's carry) is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: How totals of two stretches of rows combine.
COMBINE: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column], int]] = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}


def ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written in ranges of ``order`` (which must tell rows apart, or a hot
    value stays in one range); ``range_no`` numbers the ranges in that order."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), name)


def running(table: DataFrame, keys: list[str], order: list[Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows of a :func:`ranged` table (by ``keys``, then ``order``) with
    running totals within each key, the row itself included.  ``totals``: new
    column -> (column, "sum" or "xor")."""
    aggs = [COMBINE[how][0](col).alias(f"upto_{out}") for out, (col, how) in totals.items()]
    parts = table.groupBy("range_no", *keys).agg(*aggs)
    earlier = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("range_no", *[F.col(k).alias(f"at_{k}") for k in keys],
                           *[COMBINE[how][0](f"upto_{out}").over(earlier).alias(f"carry_{out}") for out, (_, how) in totals.items()])
    # at most one key of a range began in an earlier one: no more rows than ranges
    carried = carried.filter(F.coalesce(*[F.col(f"carry_{out}") for out in totals]).isNotNull())
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"at_{k}"))
    here = Window.partitionBy("range_no", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = table.withColumns({out: COMBINE[how][0](col).over(here) for out, (col, how) in totals.items()})
    out = inside.join(F.broadcast(carried.withColumnRenamed("range_no", "at_range")), (F.col("range_no") == F.col("at_range")) & same, "left")
    full = {o: COMBINE[how][1](F.col(o), F.coalesce(f"carry_{o}", F.lit(COMBINE[how][2]))) for o, (_, how) in totals.items()}
    return out.withColumns(full).select(*table.columns, *totals)
