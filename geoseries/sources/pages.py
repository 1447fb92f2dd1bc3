"""Landed JSON pages: GeoJSON feature collections and REST feature pages.

A page is one JSON document (one REST response).  Pages may come from files
(``read.text(wholetext=True)``, one row per file) or from any DataFrame with a
text column; either way each page is parsed with an explicit schema and its
``features`` array is exploded, so work spreads over pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import epoch_ms_to_local
from ..operators.clean import flatten, strip_prefix
from ..session import cut_lineage

GEOMETRY = T.StructType([T.StructField("type", T.StringType()),
                         T.StructField("coordinates", T.StringType())])


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed pages as ``(page_no, text)``.

    ``lines=False``: one JSON document per file; ``lines=True``: one document
    per line.  Page order = file name order, then line order.  Pages are
    numbered by a window over their names and line numbers only; the text never
    enters it and joins the numbers afterwards.
    """
    if lines:
        df = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"),
                                          F.monotonically_increasing_id().alias("_r"), "value")
    else:
        df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_f"),
                                                          F.lit(0).alias("_r"), "value")
    df = df.where(F.length(F.trim("value")) > 0)
    numbers = df.select("_f", "_r").withColumn("page_no", F.row_number().over(Window.orderBy("_f", "_r")))
    return df.join(numbers, ["_f", "_r"]).select("page_no", F.col("value").alias("text"))


# ---- what a landed page is -------------------------------------------------------------
ERROR = T.StructType([T.StructField("code", T.LongType()), T.StructField("message", T.StringType())])
PAGE_CLASSES = ("ok", "empty", "error", "corrupt", "no_features")
USABLE = ("ok", "empty")


def parsed_pages(pages: DataFrame, schema: T.StructType, text_col: str = "text") -> DataFrame:
    """``(page_no, d, page_class, error_code, error_message)``: every page parsed
    once and classed - ``error`` (the service's error object instead of data),
    ``corrupt`` (cut or broken JSON), ``no_features`` (valid JSON of another
    kind), ``empty`` (a page without rows) or ``ok``."""
    full = T.StructType([*schema.fields, *([] if "error" in schema.names else [T.StructField("error", ERROR)]), T.StructField("_corrupt", T.StringType())])
    doc = pages.select("page_no", F.from_json(text_col, full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    n = F.size("d.features")
    kind = (F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), F.lit("corrupt"))
            .when(F.col("d.error").isNotNull(), F.lit("error"))
            .when(F.col("d.features").isNull(), F.lit("no_features"))
            .when(n == 0, F.lit("empty")).otherwise(F.lit("ok")))
    return doc.select("page_no", "d", kind.alias("page_class"), F.col("d.error.code").alias("error_code"), F.col("d.error.message").alias("error_message"))


def good_pages(pages: DataFrame, schema: T.StructType, text_col: str = "text", on_bad: str = "raise") -> DataFrame:
    """The parsed pages that hold rows or say there are none.  ``on_bad``:
    ``'raise'`` fails the merge at any other page (a merge without it would be
    short, unseen), ``'drop'`` leaves those pages to :func:`page_errors`."""
    if on_bad not in ("raise", "drop"):
        raise ValueError("on_bad must be 'raise' or 'drop'")
    doc = parsed_pages(pages, schema, text_col)
    usable = F.col("page_class").isin(*USABLE)
    if on_bad == "drop":
        return doc.where(usable)
    msg = F.concat_ws(" ", F.lit("page"), F.col("page_no").cast("string"), F.lit("cannot be merged:"), "page_class", F.col("error_code").cast("string"), "error_message")
    return doc.where(F.when(usable, F.lit(True)).otherwise(F.raise_error(msg).cast("boolean")))


def page_errors(pages: DataFrame, schema: T.StructType, text_col: str = "text") -> DataFrame:
    """``(page_class, error_code, pages, rows, first_page, last_page)`` of all pages."""
    doc = parsed_pages(pages, schema, text_col)
    rows = F.when(F.col("page_class").isin(*USABLE), F.size("d.features")).otherwise(0)
    return doc.groupBy("page_class", "error_code").agg(F.count(F.lit(1)).alias("pages"), F.sum(rows).cast("bigint").alias("rows"),
                                                       F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def geojson_schema(properties: T.StructType) -> T.StructType:
    feature = T.StructType([
        T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
        T.StructField("properties", properties), T.StructField("geometry", GEOMETRY)])
    return T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.StructType([T.StructField("exceededTransferLimit", T.BooleanType())])),
        T.StructField("features", T.ArrayType(feature))])


def geojson_features(pages: DataFrame, properties: T.StructType, text_col: str = "text", on_bad: str = "raise") -> DataFrame:
    """Feature-collection pages -> one row per feature, flattened, ``type`` and
    ``id`` dropped, ``properties.`` prefix stripped (S2, S3, S5, P2, P3, P4).
    ``geometry.coordinates`` stays JSON text (nesting depth differs by type)."""
    doc = good_pages(pages, geojson_schema(properties), text_col, on_bad)
    feats = doc.select("page_no", F.posexplode("d.features").alias("feature_pos", "f")).select(
        "page_no", "feature_pos", "f.*")
    flat = flatten(feats).drop("type", "id")
    return strip_prefix(flat, "properties.")


def feature_page_schema(attributes: T.StructType) -> T.StructType:
    feature = T.StructType([T.StructField("attributes", attributes),
                            T.StructField("geometry", T.StructType([T.StructField("x", T.DoubleType()),
                                                                    T.StructField("y", T.DoubleType())]))])
    return T.StructType([T.StructField("features", T.ArrayType(feature)),
                         T.StructField("exceededTransferLimit", T.BooleanType())])


def feature_rows(pages: DataFrame, attributes: T.StructType, text_col: str = "text",
                 ts_col: str = "call_timestamp", tz: str = "America/New_York", on_bad: str = "raise") -> DataFrame:
    """REST feature pages -> one row per record: ``attributes.*`` (geometry x/y
    dropped), the epoch-ms timestamp as local wall-clock time renamed
    ``<ts>_EST`` (S4, P2, P3, P8, U1).  ``on_bad``: see :func:`good_pages`."""
    doc = good_pages(pages, feature_page_schema(attributes), text_col, on_bad)
    rows = doc.select("page_no", F.inline("d.features")).select("page_no", "attributes.*")
    if ts_col in rows.columns:
        rows = rows.withColumn(ts_col + "_EST", epoch_ms_to_local(ts_col, tz)).drop(ts_col)
    return rows


# ---- O2: pages in the order of an id -----------------------------------------------------
def rows_by_id(rows: DataFrame, id_col: str) -> DataFrame:
    """Merged rows sorted by id, as the pages were asked for (a range sort; for sinks)."""
    return rows.orderBy(F.col(id_col).asc_nulls_last(), "page_no")


def page_order_audit(rows: DataFrame, id_col: str, pos_col: str = "feature_pos") -> DataFrame:
    """Per page whether its rows ascend by id and whether it starts after the page
    before it ended: paging by offset skips or repeats rows where it does not (O2).
    The page before is found by its number, so no task sees the whole page list."""
    per = rows.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("rows"), F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"),
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(id_col).alias("i")))).alias("_at"))   # one page's ids
    ids = F.transform("_at", lambda r: r["i"])
    per = per.withColumn("ascending", ids == F.array_sort(ids)).drop("_at")
    before = per.select((F.col("page_no") + 1).alias("page_no"), F.col("max_id").alias("_before"))
    follows = F.coalesce(F.col("min_id") > F.col("_before"), F.lit(True))
    return per.join(before, "page_no", "left").select("page_no", "rows", "min_id", "max_id", "ascending", follows.alias("follows"))


def page_keys(pages: DataFrame, schema: T.StructType, text_col: str = "text") -> DataFrame:
    """Non-feature keys merged over pages (S5): a key present in a later page
    overwrites it; a key absent there keeps the earlier page's value."""
    doc = pages.select("page_no", F.from_json(text_col, schema).alias("d"))
    keys = [f.name for f in schema.fields if f.name != "features"]

    def latest(k):
        v = F.col(f"d.{k}")
        return F.max_by(v, F.when(v.isNotNull(), F.col("page_no"))).alias(k)
    return doc.agg(*[latest(k) for k in keys])


PAGE_BUCKET = 10000   # pages per bucket of the two-level running sum


def page_audit(pages: DataFrame, schema: T.StructType, text_col: str = "text",
               flag: str = "exceededTransferLimit") -> DataFrame:
    """Per page: rows, the more-rows flag, the offset the next request would
    use (running sum of the rows of earlier pages), and whether the flag is
    consistent: every page but the last must say more rows follow, the last
    must not, and a page that is no page of rows (:func:`parsed_pages`) never is (S6).

    The running sum is two-level so no task holds the whole page list: a
    window per bucket of ``PAGE_BUCKET`` pages, plus a prefix sum over the
    (few) bucket totals."""
    doc = parsed_pages(pages, schema, text_col)
    usable = F.col("page_class").isin(*USABLE)
    per = doc.select("page_no", F.when(usable, F.size("d.features")).otherwise(0).cast("bigint").alias("rows"), "page_class",
                     F.coalesce(F.col(f"d.{flag}"), F.lit(False)).alias("more"),
                     F.floor(F.col("page_no") / PAGE_BUCKET).alias("_b"))
    per = cut_lineage(per, "page-rows")   # a few numbers a page: the pages are gathered and parsed once
    within = Window.partitionBy("_b").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_in", F.coalesce(F.sum("rows").over(within), F.lit(0)))
    totals = per.groupBy("_b").agg(F.sum("rows").alias("_t"), F.max("page_no").alias("_bmax"))
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.max("_bmax").over(Window.partitionBy()).alias("_last"))
    per = per.join(totals, "_b")
    ok = F.when(F.col("page_no") == F.col("_last"), ~F.col("more")).otherwise(F.col("more"))
    ok = ok & F.col("page_class").isin(*USABLE)
    return per.select("page_no", "page_class", "rows", "more", (F.col("_before") + F.col("_in")).cast("bigint").alias("offset"),
                      ok.alias("consistent"))
