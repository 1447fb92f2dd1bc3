"""Cleaning, filtering and de-duplication.

All rules are row-local except the keep-first de-duplication, which aggregates
positions (map-side combine) rather than sorting rows in a window: a hot key -
even one holding a third of the rows - is reduced to one candidate per map task
before the shuffle, so no task receives the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import checked_number, checked_timestamp, rejects_of
from ..functions.text import (DROP_CATEGORIES, DROP_PRIORITIES, KEEP_SOURCES, lnglat_from_text,
                              parse_twitter_time, strip_ws)
from ..session import DEFAULT_BROADCAST_LIMIT, cut_lineage
from .geo import label_points, relabel

ORDER_COLS = ["file_seq", "block_start", "row_seq"]

# The columns of the cleaned tables.
CALL_COLUMNS = ["call_timestamp", "incident_id", "officerinitiated", "priority",
                "calldescription", "category", "neighborhood", "longitude", "latitude"]
POST_COLUMNS = ["created_at", "id_str", "text", "user", "source", "lng", "lat", "FID_nhood"]


# ---- P1 / P2 / P3 / P4 -----------------------------------------------------------
def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[c[len(prefix):] if c.startswith(prefix) else c for c in df.columns])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Expand nested structs into top-level columns named ``a.b.c`` (json_normalize)."""
    def walk(dtype, path):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path
    cols = []
    for f in df.schema.fields:
        for p in walk(f.dataType, [f.name]):
            ref = F.col(".".join(f"`{x}`" for x in p))
            cols.append(ref.alias(sep.join(p)))
    return df.select(*cols)


# ---- P5 / P6 / P7 ----------------------------------------------------------------
def trim_strings(df: DataFrame, exclude: Sequence[str] = (), python_strip: bool = True) -> DataFrame:
    """Strip every string column (P5)."""
    fn = strip_ws if python_strip else F.trim
    cols = {f.name: fn(F.col(f"`{f.name}`")) for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude}
    return df.withColumns(cols)


# ---- F1 / F2 / F3 / F8 / F10 -----------------------------------------------------
def time_range(df: DataFrame, ts_col: str, start, end) -> DataFrame:
    """Half-open ``start <= ts < end`` (F1); pushed to the Parquet scan."""
    return df.where((F.col(ts_col) >= F.lit(start)) & (F.col(ts_col) < F.lit(end)))


def last_days(df: DataFrame, ts_col: str, now, days: int = 30) -> DataFrame:
    """``now - days <= ts < now`` with ``now`` given by the caller (F2)."""
    now_c = F.to_timestamp_ntz(F.lit(str(now)))
    return df.where((F.col(ts_col) >= now_c - F.expr(f"INTERVAL {int(days)} DAYS"))
                    & (F.col(ts_col) < now_c))


def require_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def in_list(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def bbox_filter(df: DataFrame, lng_col: str, lat_col: str, sw_lng: float, sw_lat: float,
                ne_lng: float, ne_lat: float) -> DataFrame:
    return df.where(F.col(lng_col).between(sw_lng, ne_lng) & F.col(lat_col).between(sw_lat, ne_lat))


# ---- F4 / F5 / F6 / F7 -----------------------------------------------------------
def not_in_keep_null(col: str, values: Sequence) -> Column:
    """``col NOT IN values`` that keeps NULLs (plain NOT IN would drop them)."""
    return F.col(col).isNull() | ~F.col(col).isin(list(values))


def contains_any(col: str, needles: Sequence[str]) -> Column:
    """Substring match against any needle; NULL text never matches."""
    c = F.col(col)
    cond = F.lit(False)
    for n in needles:
        cond = cond | c.contains(n)
    return c.isNotNull() & cond


# ---- W1 / W2 ---------------------------------------------------------------------
def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in ``order`` (W1); NULL keys form one group.

    Only keys and positions are aggregated, with map-side combine: a key
    holding a third of all rows (or all NULL keys) is one candidate per map task
    before the shuffle.  Keys that come up more than once are written with their
    first position, and the rows that have such a key but another position are
    left out.  Whole rows are never sorted: where the repeated keys are few
    (measured) they are broadcast and the rows not even shuffled; otherwise the
    rows are hashed by key, and a hot key's partition can be split.  ``df`` is
    read twice; ``order`` must tell rows apart and be the same in both passes
    (positions taken at a file scan are).
    """
    position = F.struct(*[F.col(c) for c in order])
    k = [f"_k{i}" for i in range(len(keys))]
    repeated = (df.select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], position.alias("_p"))
                .groupBy(*k).agg(F.min("_p").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    repeated = cut_lineage(repeated, "repeated-keys")
    n = repeated.count()
    if n == 0:
        return df
    small = n * 64 * (len(keys) + len(order)) <= DEFAULT_BROADCAST_LIMIT
    same = F.lit(True)
    for c, r in zip(keys, k, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(r))
    found = df.join(F.broadcast(repeated) if small else repeated.hint("shuffle_hash"), same, "left")
    return found.where(F.col("_first").isNull() | (position == F.col("_first"))).select(*df.columns)


# ---- calls pipeline (S1 -> ... -> O1) ----------------------------------------------
ON_REJECT = ("null", "raise", "keep")


def call_casts(df: DataFrame) -> dict[str, Column]:
    """The checked casts of the call columns; only the priority must be there."""
    ts_name = "call_timestamp" if "call_timestamp" in df.columns else "call_timestamp_EST"
    return {"call_timestamp": checked_timestamp(ts_name), "incident_id": checked_number("incident_id", "bigint"),
            "priority": checked_number("priority", "tinyint", required=True),
            "longitude": checked_number("longitude", "double"), "latitude": checked_number("latitude", "double")}


def rule_filtered(raw: DataFrame) -> DataFrame:
    """Null-neighbourhood drop -> strip -> category -> priority, in this order."""
    df = require_not_null(raw, ["neighborhood"])
    df = trim_strings(df, exclude=ORDER_COLS)
    df = df.where(not_in_keep_null("category", DROP_CATEGORIES))
    return df.where(not_in_keep_null("priority", DROP_PRIORITIES))


def stage_calls(raw: DataFrame, on_reject: str = "null") -> DataFrame:
    """Per-file rules in the reference's order, then select and typed casts.

    ``on_reject``: what a text does that its column's type refuses - ``'null'``
    gives NULL for the value (:func:`call_reject_audit` counts those),
    ``'raise'`` fails the job with file, column, reason and text (as the
    reference does), ``'keep'`` adds ``rejects``, the refused casts of the row.
    """
    if on_reject not in ON_REJECT:
        raise ValueError(f"on_reject must be one of {ON_REJECT}")
    df = rule_filtered(raw)
    casts = call_casts(df)
    if on_reject != "null":
        df = df.withColumn("rejects", rejects_of(casts))
    if on_reject == "raise":
        first = F.element_at("rejects", 1)
        msg = F.concat_ws(" ", F.lit("refused cast in file"), F.col("file_seq").cast("string"), F.lit("column"), first["column"], first["reason"],
                          F.concat(F.lit("'"), F.coalesce(first["text"], F.lit("")), F.lit("'")))
        # in a filter, so that a query which reads other columns only fails too
        df = df.where(F.when(F.size("rejects") > 0, F.raise_error(msg).cast("boolean")).otherwise(F.lit(True))).drop("rejects")
    typed = {n: c["value"].alias(n) for n, c in casts.items()}
    kept = ["rejects"] if on_reject == "keep" else []
    return df.select(*[typed.get(c, F.col(c)) for c in CALL_COLUMNS], *ORDER_COLS, *kept)


def call_reject_audit(raw: DataFrame) -> DataFrame:
    """Refused casts among the rows that the rules keep: rows per file, column and reason."""
    df = rule_filtered(raw)
    each = df.select("file_seq", F.explode(rejects_of(call_casts(df))).alias("r"))
    return each.groupBy("file_seq", F.col("r.column").alias("column"), F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def rejected_calls(raw: DataFrame) -> DataFrame:
    """The rows with a refused cast as they came (trimmed), with ``rejects``: to be set aside and looked at."""
    df = rule_filtered(raw)
    return df.withColumn("rejects", rejects_of(call_casts(df))).where(F.size("rejects") > 0)


def clean_calls(raw: DataFrame, polys: DataFrame, relabel_names: Sequence[str],
                on_unknown: str = "error", on_reject: str = "null") -> DataFrame:
    """Calls: stage -> keep first per incident_id -> relabel -> drop unlabelled.
    ``on_reject``: ``'null'`` or ``'raise'``, see :func:`stage_calls`."""
    staged = stage_calls(raw, on_reject)
    first = keep_first(staged, ["incident_id"], ORDER_COLS)
    labelled = relabel(first, polys, relabel_names, name_col="neighborhood",
                       lng_col="longitude", lat_col="latitude", on_unknown=on_unknown)
    return keep_columns(require_not_null(labelled, ["FID_nhood"]), [*CALL_COLUMNS, "FID_nhood"])


def calls_stage_audit(raw: DataFrame) -> DataFrame:
    """Rows per file after each cleaning rule, and of the rows kept those with a
    refused cast, one pass (A11)."""
    s = strip_ws
    ok_n = F.col("neighborhood").isNotNull()
    cat, pri = s(F.col("category")), s(F.col("priority"))
    ok_c = ok_n & (cat.isNull() | ~cat.isin(DROP_CATEGORIES))
    ok_p = ok_c & (pri.isNull() | ~pri.isin(DROP_PRIORITIES))
    return raw.groupBy("file_seq").agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(ok_n).alias("with_nhood"),
        F.count_if(ok_c).alias("category_kept"), F.count_if(ok_p).alias("kept"),
        F.count_if(ok_p & (F.size(rejects_of(call_casts(raw))) > 0)).alias("with_rejects"))


def posts_stage_audit(raw: DataFrame, polys: DataFrame) -> DataFrame:
    """Rows per file after each posts rule: raw, unique ids, geo-tagged, inside a
    polygon, kept by source (A11)."""
    raw_n = raw.groupBy("file_seq").agg(F.count(F.lit(1)).alias("raw_rows"))
    per_file = keep_first(raw, ["file_seq", "id_str"], ORDER_COLS)
    lng, lat = lnglat_from_text("coordinates")
    tagged = per_file.withColumn("lng", lng).withColumn("lat", lat)
    labelled = label_points(tagged, polys, "lng", "lat", out_col="_k",
                            only_when=F.col("coordinates").isNotNull())
    has = F.col("coordinates").isNotNull()
    inside = has & F.col("_k").isNotNull()
    stages = labelled.groupBy("file_seq").agg(
        F.count(F.lit(1)).alias("unique_rows"), F.count_if(has).alias("geo_tagged"),
        F.count_if(inside).alias("in_area"),
        F.count_if(inside & contains_any("source", KEEP_SOURCES)).alias("kept"))
    return raw_n.join(stages, "file_seq", "left")


# ---- posts pipeline (W2) ---------------------------------------------------------
def clean_posts(raw: DataFrame, polys: DataFrame) -> DataFrame:
    """Two-phase de-duplication: per file *before* the geo filters, again after
    the union (a later geo-tagged copy in the same file is lost, one in another
    file survives)."""
    per_file = keep_first(raw, ["file_seq", "id_str"], ORDER_COLS)
    tagged = per_file.where(F.col("coordinates").isNotNull())
    lng, lat = lnglat_from_text("coordinates")
    tagged = drop_columns(tagged.withColumn("lng", lng).withColumn("lat", lat), ["coordinates"])
    labelled = label_points(tagged, polys, "lng", "lat", out_col="FID_nhood")
    kept = (labelled.where(F.col("FID_nhood").isNotNull())
                    .where(contains_any("source", KEEP_SOURCES)))
    # few rows are left, and locating them is the dear part: written before they are read twice
    kept = cut_lineage(kept.select(*POST_COLUMNS, *ORDER_COLS), "located-posts")
    once = keep_first(kept, ["id_str"], ORDER_COLS)
    return once.select(parse_twitter_time("created_at").alias("created_at"),
                       *[c for c in POST_COLUMNS if c != "created_at"])
