"""Stand-in inputs built from the driver's test tables.

The reference's own inputs (emergency-call CSVs, neighbourhood polygons,
geo-tagged posts) are not available, so each is re-shaped from a driver table
into the schema the jobs expect.  These builders only produce rows of that
schema; no job result is taken from how they are made.  The same rules are
written as SQL in :mod:`geoseries.plans.oracle` so the DuckDB oracle sees the
same input.

Shapes (all deterministic):

* ``calls_raw``  - all-STRING call records from ``events``, two "files": file 2
  repeats every event one hour later with some priorities changed.
* ``polygons``   - one chamfered 2x2 square per ``nation`` row on a 10x10 board
  (top-left corner cut: gaps between squares, shared edges and corners); the
  nation with key 17 carries the name of nation 3 (a duplicated name).
* ``posts_raw``  - posts from ``documents`` (id = md5 of the text, so exact copies
  are duplicates), two files by ``doc_id`` parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geo import polygons_from_table
from ..session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed stand-in parameters
# ---------------------------------------------------------------------------
N_NHOODS = 25                 # nations used as neighbourhoods
ALIAS_FROM, ALIAS_TO = 17, 3  # nation 17 shares the name of nation 3
SOURCE_APPS = ["Twitter for iPhone", "Instagram", "Foursquare", "Tweetlogix", "Untappd",
               "Twitter for Android", "TweetMyJOBS", "Paper.li", "dlvr.it", "IFTTT"]
# Area box of the stand-in board (sw_lng, sw_lat, ne_lng, ne_lat).
AREA_BOX = (0.0, 0.0, 10.0, 10.0)


# Keys of the stand-in neighbourhoods (25 nations; number 17 has the name of number 3).
NHOOD_KEYS = [f"{i},NATION_{3 if i == 17 else i}" for i in range(25)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nhood_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    m = n.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("nhood_name"))
    target = F.when(F.col("n_nationkey") == ALIAS_FROM, F.lit(ALIAS_TO)).otherwise(F.col("n_nationkey"))
    return (n.join(F.broadcast(m), target == F.col("_k"), "left")
             .select(F.col("n_nationkey").alias("nhood_num"), "nhood_name"))


def neighbourhood_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV-like neighbourhood table: ``nhood_num, nhood_name, geometry.type,
    geometry.coordinates`` (text) - the input of the polygon scan (S7)."""
    k = F.col("nhood_num")
    x0 = (k % 5) * 2
    y0 = F.floor(k / 5) * 2

    def pt(x, y):
        return F.format_string("[%.1f, %.1f]", x.cast("double"), y.cast("double"))
    ring = F.concat(F.lit("[["), F.concat_ws(", ", pt(x0, y0), pt(x0 + 2, y0), pt(x0 + 2, y0 + 2),
                                             pt(x0 + 1, y0 + 2), pt(x0, y0 + 1), pt(x0, y0)),
                    F.lit("]]"))
    return nhood_names(spark, sf_dir).select(
        "nhood_num", "nhood_name", F.lit("Polygon").alias("geometry.type"),
        ring.alias("geometry.coordinates"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon dimension, written once (small table) so its several consumers
    read it instead of re-deriving it."""
    return cut_lineage(polygons_from_table(neighbourhood_table(spark, sf_dir), pos_col="nhood_num",
                                           type_col="geometry.type"), "polygons")


def _fmt2(x):
    """Text with two decimals (same as printf ``%.2f`` for these values)."""
    return x.cast("decimal(14,2)").cast("string")


def calls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    names = nhood_names(spark, sf_dir)
    base = ev.join(F.broadcast(names), F.pmod(F.col("user_id"), F.lit(N_NHOODS)) == F.col("nhood_num"), "left")
    eid = F.col("event_id")
    id_txt = F.when(eid >= 1000, F.concat(F.expr("cast(event_id div 1000 as string)"), F.lit(","),
                                          F.lpad((eid % 1000).cast("string"), 3, "0"))) \
              .otherwise(eid.cast("string"))
    p1 = (F.when(eid % 50 == 0, F.lit("P")).when(eid % 50 == 1, F.lit(" "))
           .otherwise(F.concat(F.lit(" "), (eid % 5 + 1).cast("string"))))
    p2 = F.when(eid % 50 == 1, F.lit("2")).when(eid % 50 == 2, F.lit("P")).otherwise(p1)
    cat = (F.when(eid % 17 == 0, F.lit("TOW   ")).when(eid % 19 == 0, F.lit(None).cast("string"))
            .when(eid % 23 == 0, F.lit(" HNGUP"))
            .otherwise(F.rpad(F.upper("event_type"), 10, " ")))
    desc = F.when(eid % 11 == 0, F.lit(None).cast("string")) \
            .otherwise(F.concat(F.col("event_type"), F.lit(" call "), (F.col("user_id") % 7).cast("string")))
    common = [
        id_txt.alias("incident_id"),
        F.when(eid % 3 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("officerinitiated"),
        desc.alias("calldescription"), cat.alias("category"),
        F.when(eid % 40 == 0, F.lit(None).cast("string")).otherwise(F.col("nhood_name")).alias("neighborhood"),
        _fmt2((eid * 37) % 1100 / 100.0).alias("longitude"),
        _fmt2((eid * 91) % 1100 / 100.0).alias("latitude"),
        _fmt2(F.col("value") - 5).alias("dispatchtime"),
        _fmt2(F.col("value")).alias("totalresponsetime"),
        F.lit(0).cast("bigint").alias("block_start"), eid.alias("row_seq")]
    f1 = base.select(F.lit(1).alias("file_seq"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("call_timestamp"),
                     p1.alias("priority"), *common)
    f2 = base.select(F.lit(2).alias("file_seq"),
                     F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss")
                     .alias("call_timestamp"),
                     p2.alias("priority"), *common)
    return f1.unionByName(f2)


def posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    did = F.col("doc_id")
    ts = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, "
                "cast(pmod(doc_id * 37, 43200) as int), cast(pmod(doc_id, 60) as decimal(18,6)))")
    app_idx = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)") % len(SOURCE_APPS)
    apps = F.array(*[F.lit(a) for a in SOURCE_APPS])
    coords = F.when(did % 9 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("["), _fmt2((did * 37) % 1100 / 100.0), F.lit(", "),
                 _fmt2((did * 53) % 1100 / 100.0), F.lit("]")))
    return d.select(
        (F.pmod(did, F.lit(2)) + 1).cast("int").alias("file_seq"),
        F.lit(0).cast("bigint").alias("block_start"), did.alias("row_seq"),
        F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        F.md5("text").alias("id_str"), "text",
        F.concat(F.lit("u"), (did % 97).cast("string")).alias("user"),
        F.element_at(apps, app_idx + 1).alias("source"),
        coords.alias("coordinates"))


def calls_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`calls_raw` with texts that their column's type refuses, by row number."""
    k = F.col("row_seq") % 101
    bad = {"call_timestamp": {7: "01/02/2020 01:00", 8: None}, "priority": {9: "300", 10: "high", 11: None, 15: "2.5"},
           "longitude": {12: "83.1W", 16: " 1,083.5 "}, "latitude": {13: "NaN"}, "incident_id": {14: "A-17"}}
    out = calls_raw(spark, sf_dir)
    for name, texts in bad.items():
        col = F.col(name)
        for at, text in texts.items():
            col = F.when(k == at, F.lit(text).cast("string")).otherwise(col)
        out = out.withColumn(name, col)
    return out


PAGE_SIZE = 500   # records per landed REST page
GEO_PAGE = 10     # features per landed GeoJSON page


def call_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed REST pages of call records from ``events``: ``(page_no, text)``.
    Records are paged by id; every page but the last says more rows follow."""
    ev = table(spark, sf_dir, "events")
    feat = F.struct(
        F.struct(F.col("event_id").alias("incident_id"),
                 F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))
                 .alias("call_timestamp"),
                 F.upper("event_type").alias("category"),
                 (F.col("event_id") % 5 + 1).cast("string").alias("priority")).alias("attributes"),
        F.struct(((F.col("event_id") * 37) % 1100 / 100.0).cast("double").alias("x"),
                 ((F.col("event_id") * 91) % 1100 / 100.0).cast("double").alias("y")).alias("geometry"))
    page_no = F.floor(F.col("event_id") / PAGE_SIZE) + 1
    pages = ev.groupBy(page_no.alias("page_no")).agg(F.array_sort(F.collect_list(feat)).alias("features"))
    last = ev.agg(F.max(page_no)).scalar()  # of the numbers alone: no task sees the records of all pages
    pages = pages.withColumn("_more", F.when(F.col("page_no") < last, F.lit(True)))
    return pages.select("page_no", F.to_json(F.struct(F.col("features"),
                                                      F.col("_more").alias("exceededTransferLimit"))).alias("text"))


def call_pages_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`call_pages` as a faulty service lands them: error objects, cut
    documents, pages without rows, other JSON."""
    kind = F.col("page_no") % 7
    error = F.concat(F.lit('{"error": {"code": '), (F.lit(400) + F.col("page_no") % 2 * 100).cast("string"), F.lit(', "message": "refused", "details": []}}'))
    text = (F.when(kind == 2, error).when(kind == 3, F.expr("substring(text, 1, length(text) div 2)"))
            .when(kind == 4, F.lit('{"features": []}')).when(kind == 5, F.lit('{"status": "ok"}')).otherwise(F.col("text")))
    return call_pages(spark, sf_dir).select("page_no", text.alias("text"))


def boundary_pages(spark: SparkSession, sf_dir: str, unit: str = "block") -> DataFrame:
    """Landed GeoJSON FeatureCollection pages of the stand-in block (default)
    or neighbourhood polygons."""
    p = blocks(spark, sf_dir) if unit == "block" else polygons(spark, sf_dir)
    coords = F.array(F.transform("ring", lambda q: F.array(q.x, q.y)))
    feat = F.struct(F.lit("Feature").alias("type"), F.col("nhood_num").cast("long").alias("id"),
                    F.struct(F.col("nhood_num").alias("FID"), F.col("nhood_name").alias("nhood_name"))
                    .alias("properties"),
                    F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"))
    page_no = F.floor(F.col("nhood_num") / GEO_PAGE) + 1
    pages = (p.groupBy(page_no.alias("page_no"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col("nhood_num").alias("_k"), feat.alias("f"))))
                   .alias("_fs")))
    last = p.agg(F.max(page_no)).scalar()
    more = F.struct(F.when(F.col("page_no") < last, F.lit(True)).alias("exceededTransferLimit"))
    doc = F.struct(F.lit("FeatureCollection").alias("type"), more.alias("properties"),
                   F.transform("_fs", lambda s: s.f).alias("features"))
    return pages.select("page_no", F.to_json(doc).alias("text"))


def status_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status JSON documents from ``events`` joined with ``customer`` (author),
    ``value`` = JSON text.  Some statuses have no author, no coordinates or no place."""
    ev = table(spark, sf_dir, "events")
    cu = table(spark, sf_dir, "customer")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    d = (ev.join(cu, ev.user_id + 1 == cu.c_custkey, "left")
           .join(F.broadcast(nat), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    eid = F.col("event_id")
    user = F.when(eid % 13 != 0, F.struct(
        F.col("c_custkey").cast("string").alias("id_str"), F.col("c_name").alias("name"),
        F.lower("c_name").alias("screen_name"), F.col("c_mktsegment").alias("location"),
        F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("balance "), F.format_string("%.2f", F.col("c_acctbal"))).alias("description"),
        (F.col("c_acctbal") < 0).alias("protected"), (F.col("c_nationkey") % 2 == 0).alias("verified"),
        (F.col("c_custkey") * 3).alias("followers_count"), (F.col("c_custkey") % 100).alias("friends_count"),
        (F.col("c_custkey") % 7).alias("listed_count"), (F.col("c_custkey") % 50).alias("favourites_count"),
        (F.col("c_custkey") * 11).alias("statuses_count"),
        F.lit("Mon Jan 01 00:00:00 +0000 2018").alias("created_at"),
        (F.col("c_custkey") % 3 == 0).alias("default_profile"), F.lit(False).alias("default_profile_image"),
        (F.col("c_custkey") % 2 == 1).alias("geo_enabled")))
    lng = ((eid * 37) % 1100 / 100.0).cast("double")
    lat = ((eid * 91) % 1100 / 100.0).cast("double")
    coords = F.when(eid % 4 != 0, F.struct(F.array(lng, lat).alias("coordinates"), F.lit("Point").alias("type")))
    box = F.struct(F.lit("Polygon").alias("type"),
                   F.array(F.array(F.array(F.floor(lng).cast("double"), F.floor(lat).cast("double")),
                                   F.array(F.floor(lng).cast("double") + 1, F.floor(lat).cast("double") + 1)))
                   .alias("coordinates"))
    place = F.when((eid % 5 == 0) & F.col("n_name").isNotNull(), F.struct(
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("url"), F.lit("city").alias("place_type"),
        F.col("n_name").alias("name"), F.concat(F.col("n_name"), F.lit(", XX")).alias("full_name"),
        F.lit("XX").alias("country_code"), F.lit("Testland").alias("country"), box.alias("bounding_box")))
    status = F.struct(
        F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        eid.cast("string").alias("id_str"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("text"),
        user.alias("user"), F.lit("Twitter for Android").alias("source"), F.lit(False).alias("truncated"),
        F.lit(None).cast("string").alias("in_reply_to_status_id_str"),
        F.lit(None).cast("string").alias("in_reply_to_user_id_str"),
        (eid % 6 == 0).alias("is_quote_status"), (eid % 9).alias("retweet_count"),
        (eid % 8).alias("favorite_count"), F.lit(False).alias("favorited"), F.lit(False).alias("retweeted"),
        F.lit("en").alias("lang"), coords.alias("coordinates"), place.alias("place"))
    return d.select("ts", F.to_json(status).alias("value"))


BLOCK_COLS = 20   # blocks per row of the block board


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-block boundary table from ``supplier`` (grows with the scale factor):
    unit squares on a board ``BLOCK_COLS`` wide, top-left corner cut, named by
    nation so many blocks share a name.  Same columns as
    :func:`neighbourhood_table`."""
    k = F.col("s_suppkey")
    x0 = (k % BLOCK_COLS).cast("double")
    y0 = F.floor(k / BLOCK_COLS).cast("double")

    def pt(x, y):
        return F.format_string("[%.1f, %.1f]", x, y)
    ring = F.concat(F.lit("[["), F.concat_ws(", ", pt(x0, y0), pt(x0 + 1, y0), pt(x0 + 1, y0 + 1),
                                             pt(x0 + 0.5, y0 + 1), pt(x0, y0 + 0.5), pt(x0, y0)),
                    F.lit("]]"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("nhood_num"), F.concat(F.lit("BLOCK_"), F.col("s_nationkey").cast("string")).alias("nhood_name"),
        F.lit("Polygon").alias("geometry.type"), ring.alias("geometry.coordinates"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block polygons, written once like :func:`polygons`."""
    return cut_lineage(polygons_from_table(block_table(spark, sf_dir), pos_col="nhood_num",
                                           type_col="geometry.type"), "blocks")


def block_table_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`block_table` with geometries that give no polygon, by number."""
    k, c = F.col("nhood_num") % 13, F.col("`geometry.coordinates`")
    coords = (F.when(k == 2, F.expr("substring(`geometry.coordinates`, 1, 12)")).when(k == 3, F.lit("[[[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]]]"))
              .when(k == 4, F.lit("[[[1.0, null], [3.0, 4.0], [5.0, 9.0]]]")).when(k == 5, F.lit(None).cast("string"))
              .when(k == 6, F.lit("[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]")).otherwise(c))
    return block_table(spark, sf_dir).select(
        "nhood_num", "nhood_name", F.when(k == 1, F.lit("MultiPolygon")).otherwise(F.col("`geometry.type`")).alias("geometry.type"),
        coords.alias("geometry.coordinates"))
