"""Social-post status JSON -> tweet, user and place rows (P14, P15, P16, F11, S13 schema).

Explicit schema for the status document; every projection is a struct field
select, vectorised over all statuses at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Attribute lists kept per object
# ---------------------------------------------------------------------------
TWEET_ATTS = ["created_at", "id_str", "text", "user", "source", "truncated", "in_reply_to_status_id_str",
              "in_reply_to_user_id_str", "is_quote_status", "retweet_count", "favorite_count",
              "favorited", "retweeted", "lang", "coordinates", "place"]
USER_ATTS = ["id_str", "name", "screen_name", "location", "url", "description", "protected", "verified",
             "followers_count", "friends_count", "listed_count", "favourites_count", "statuses_count",
             "created_at", "default_profile", "default_profile_image", "geo_enabled"]
PLACE_ATTS = ["id", "url", "place_type", "name", "full_name", "country_code", "country", "bounding_box"]

S, B, L = T.StringType(), T.BooleanType(), T.LongType()
USER = T.StructType([T.StructField(n, t) for n, t in [
    ("id_str", S), ("name", S), ("screen_name", S), ("location", S), ("url", S), ("description", S),
    ("protected", B), ("verified", B), ("followers_count", L), ("friends_count", L), ("listed_count", L),
    ("favourites_count", L), ("statuses_count", L), ("created_at", S), ("default_profile", B),
    ("default_profile_image", B), ("geo_enabled", B)]])
BOX = T.StructType([T.StructField("type", S),
                    T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
PLACE = T.StructType([T.StructField(n, t) for n, t in [
    ("id", S), ("url", S), ("place_type", S), ("name", S), ("full_name", S), ("country_code", S),
    ("country", S), ("bounding_box", BOX)]])
COORDS = T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType())), T.StructField("type", S)])
STATUS = T.StructType([T.StructField(n, t) for n, t in [
    ("created_at", S), ("id_str", S), ("text", S), ("user", USER), ("source", S), ("truncated", B),
    ("in_reply_to_status_id_str", S), ("in_reply_to_user_id_str", S), ("is_quote_status", B),
    ("retweet_count", L), ("favorite_count", L), ("favorited", B), ("retweeted", B), ("lang", S),
    ("coordinates", COORDS), ("place", PLACE)]])


def parse_statuses(df: DataFrame, text_col: str = "value", fields: Sequence[str] | None = None) -> DataFrame:
    """Every status parsed once: a generator of one row, as a filter on a plain
    column would parse the text again for each field it names.

    With ``fields`` only these attributes are read, as rows ``(*fields)``.  Of a
    document that is cut or holds a value its type refuses, a parse keeps what
    depends on the attributes it reads; such a document (only such) is parsed in
    full, so its row is the same either way."""
    if fields is None:
        return df.select(F.inline(F.array(F.from_json(text_col, STATUS))))
    some = T.StructType([STATUS[a] for a in fields] + [T.StructField("_broken", S)])
    found = df.select(F.col(text_col).alias("_text"),
                      F.inline(F.array(F.from_json(text_col, some, {"columnNameOfCorruptRecord": "_broken"}))))
    whole = F.transform(F.array(F.from_json("_text", STATUS)), lambda s: F.struct(*[s.getField(a).alias(a) for a in fields]))
    return found.select(F.inline(F.when(F.col("_broken").isNull(), F.array(F.struct(*fields))).otherwise(whole)))


def list_text(arr: Column) -> Column:
    """``[a, b]`` text of a number list (comma + space, like a printed list)."""
    return F.when(arr.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: x.cast("string")),
                                                                     ", "), F.lit("]")))


def provenance(query_time, query_geo) -> list[Column]:
    """``query_time``, ``query_geo`` columns (P16); pass the time explicitly for
    deterministic reruns, or ``None`` for the current time."""
    qt = F.current_timestamp() if query_time is None else F.to_timestamp_ntz(F.lit(str(query_time)))
    return [qt.alias("query_time"), F.lit(query_geo).cast("string").alias("query_geo")]


def tweet_rows(statuses: DataFrame, query_time=None, query_geo: str | None = None) -> DataFrame:
    """Status -> tweet row: 16 attributes, ``user`` -> its id, ``coordinates`` ->
    text of the [lng, lat] list (P14)."""
    cols = []
    for a in TWEET_ATTS:
        if a == "user":
            cols.append(F.col("user.id_str").alias("user"))
        elif a == "coordinates":
            cols.append(list_text(F.col("coordinates.coordinates")).alias("coordinates"))
        elif a == "place":
            cols.append(F.to_json("place").alias("place"))
        else:
            cols.append(F.col(a))
    return statuses.select(*provenance(query_time, query_geo), *cols)


def user_rows(statuses: DataFrame, query_time=None, query_geo: str | None = None) -> DataFrame:
    """Status -> user row, only when the user object is present."""
    return statuses.where(F.col("user").isNotNull()).select(
        *provenance(query_time, query_geo), *[F.col(f"user.{a}").alias(a) for a in USER_ATTS])


def place_rows(statuses: DataFrame, query_time=None, query_geo: str | None = None) -> DataFrame:
    """Status -> place row, only when the place object is present."""
    return statuses.where(F.col("place").isNotNull()).select(
        *provenance(query_time, query_geo), *[F.col(f"place.{a}").alias(a) for a in PLACE_ATTS])
