"""File scans: call CSVs, neighbourhood CSV, cleaned tables, wide forecast.

Keep-first de-duplication needs the position of every row in the input
files.  It is captured at the scan, as ordering columns:

* ``file_seq``   - the glob's position in the caller's list, then the file path
  (text, so it orders like the list, then like the file names),
* ``block_start`` - ``_metadata.file_block_start`` (split order inside a file),
* ``row_seq``    - ``monotonically_increasing_id()`` (row order inside a split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import parse_timestamp
from ..operators.geo import polygons_from_table


def with_file_order(df: DataFrame, glob_idx: int) -> DataFrame:
    return df.select("*",
                     F.concat(F.lpad(F.lit(str(glob_idx)), 6, "0"), F.lit("|"),
                              F.col("_metadata.file_path")).alias("file_seq"),
                     F.col("_metadata.file_block_start").alias("block_start"),
                     F.monotonically_increasing_id().alias("row_seq"))


def read_calls_csv(spark: SparkSession, globs: Sequence[str]) -> DataFrame:
    """All-STRING scan of call CSVs by a list of globs (e.g. one per year), with
    header, unioned by name (S1, U1).  Numbers keep their ``,`` separators
    until the typed casts (P6).  Quoted fields may hold ``""``, separators and
    newlines, so a file is read whole by one task: land large files once
    (:func:`land_calls`) and work on the landed copy."""
    frames = []
    for i, g in enumerate(globs):
        df = (spark.read.option("header", True).option("inferSchema", False)
                   .option("multiLine", True).option("escape", '"').csv(g))
        frames.append(with_file_order(df, i))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def year_globs(base: str, years: Sequence[int], pattern: str = "calls_{year}*.csv") -> list[str]:
    return [f"{base.rstrip('/')}/{pattern.format(year=y)}" for y in years]


def read_neighbourhoods_csv(spark: SparkSession, path: str,
                            id_cols: tuple[str, str] = ("nhood_num", "nhood_name")) -> DataFrame:
    """Neighbourhood CSV -> polygons (S7).  Row position in the file is the
    tie-break for duplicate keys and the first-match order."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
               .option("inferSchema", True).csv(path))
    df = df.withColumn("_pos", F.monotonically_increasing_id())
    type_col = "geometry.type" if "geometry.type" in df.columns else None
    return polygons_from_table(df, id_cols[0], id_cols[1], "geometry.coordinates", "_pos", type_col)


def read_clean_table(spark: SparkSession, path: str, ts_col: str, fmt: str = "parquet") -> DataFrame:
    """Re-read a cleaned table with its timestamp typed."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp_ntz"))


def read_wide_forecast(spark: SparkSession, path: str, id_cols: Sequence[str] = ("Day", "Hour")) -> DataFrame:
    """Wide forecast CSV: every column but the trailing ids is a neighbourhood."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(f"`{c}`").cast("int" if c in id_cols else "double").alias(c) for c in df.columns])


def land_calls(spark: SparkSession, globs: Sequence[str], out: str) -> None:
    """Land raw call CSVs as Parquet partitioned by call date (S1 -> S9).

    Columns stay text (cleaning rules apply later, unchanged) and the
    file-order columns captured at the CSV scan travel along, so keep-first
    gives the same answer on the landed copy.  Time-range jobs then prune
    whole date partitions (:func:`read_landed_calls`)."""
    raw = read_calls_csv(spark, globs)
    ts_name = "call_timestamp" if "call_timestamp" in raw.columns else "call_timestamp_EST"
    raw = raw.withColumn("call_date", F.to_date(parse_timestamp(ts_name)))
    raw.write.mode("overwrite").partitionBy("call_date").parquet(out)


def read_landed_calls(spark: SparkSession, path: str, start: str | None = None,
                      end: str | None = None) -> DataFrame:
    """Read landed calls; ``start <= date < end`` on the partition column
    prunes partitions before any file is opened (rows without a parsable time
    sit in the NULL partition and are kept only without a range).  For a
    ranged extraction apply the exact time range to the parsed timestamp
    before keep-first, as a ranged request to the source would."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("call_date") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col("call_date") < F.to_date(F.lit(end)))
    return df


def read_landed_posts(spark: SparkSession, path: str) -> DataFrame:
    """The tweet table of the entity sink as the raw posts of ``clean_posts``.

    A micro-batch is what a file is to the reference: ``file_seq`` is the batch
    (rows appended without one are one batch before the others), then the part
    file's name and the row's place in it, so keep-first has the order in which
    posts landed."""
    df = spark.read.parquet(path)
    batch = F.col("batch_id") if "batch_id" in df.columns else F.lit(-1)
    return df.select(*[c for c in df.columns if c != "batch_id"],
                     F.coalesce(batch, F.lit(-1)).cast("long").alias("file_seq"),
                     F.col("_metadata.file_name").alias("block_start"), F.col("_metadata.row_index").alias("row_seq"))


def written_order(spark: SparkSession, path: str) -> DataFrame:
    """A written Parquet table with ``position``, each row's place in the order in
    which the part files hold the rows (O1).  Rows before a file are summed over
    the files, one row each; a row's place in its file is the format's own."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = df.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = files.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return df.join(before, "_file").withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
