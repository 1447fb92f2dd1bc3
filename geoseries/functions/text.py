"""Scalar Column builders for parsing and tidying raw text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------
# Call categories dropped during cleaning.
DROP_CATEGORIES = ["HNGUP", "STRTSHFT", "REMARKS", "BUS BRD", "TOW"]
# Priority values dropped during cleaning (after trimming).
DROP_PRIORITIES = ["P", ""]
# Post sources that are kept (substring match).
KEEP_SOURCES = ["Instagram", "Twitter for Android", "Twitter for iPhone",
                "Foursquare", "Tweetlogix", "Untappd"]
# Characters Python's str.strip() removes (str.isspace() is true).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove every leading/trailing whitespace char
    (a character-set trim, no regular expression)."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


def parse_number(c, to: str = "bigint") -> Column:
    """Numbers written with ``,`` thousands separators; bad text -> NULL."""
    return F.expr(f"try_cast(replace({_sql(c)}, ',', '') as {to})")


def parse_timestamp(c, fmt: str | None = None) -> Column:
    """Text -> TIMESTAMP_NTZ (no session time-zone shift); bad text -> NULL."""
    if fmt:
        return F.expr(f"try_to_timestamp_ntz({_sql(c)}, '{fmt}')")
    return F.expr(f"try_cast({_sql(c)} as timestamp_ntz)")


def parse_twitter_time(c) -> Column:
    """``Wed Oct 10 20:19:24 +0000 2018`` -> UTC TIMESTAMP_NTZ.

    The weekday is skipped (patterns with ``EEE`` are refused for parsing);
    the offset is honoured and the instant is expressed as UTC wall-clock
    time, independent of the session time zone.
    """
    inst = F.expr(f"try_to_timestamp(substring({_sql(c)}, 5), 'MMM dd HH:mm:ss Z yyyy')")
    return F.timestamp_add("MICROSECOND", F.unix_micros(inst), F.expr(EPOCH_NTZ))


def epoch_ms_to_local(c, tz: str = "America/New_York") -> Column:
    """Epoch milliseconds (UTC) -> local wall-clock TIMESTAMP_NTZ in ``tz``."""
    utc = F.timestamp_add("MILLISECOND", _c(c), F.expr(EPOCH_NTZ))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def lnglat_from_text(c) -> tuple[Column, Column]:
    """``"[lng, lat]"`` text -> (lng, lat) doubles; element 0 is longitude."""
    arr = F.from_json(_c(c), "array<double>")
    return arr.getItem(0), arr.getItem(1)


def key_compose(num, name) -> Column:
    """Neighbourhood key ``"num,name"``."""
    return F.concat_ws(",", _c(num).cast("string"), _c(name))


def key_fid(key) -> Column:
    """FID = part before the first comma, as int."""
    return F.expr(f"try_cast(split_part({_sql(key)}, ',', 1) as int)")


def key_name(key) -> Column:
    """Name = second comma-separated part (a comma inside a name truncates it)."""
    return F.split_part(_c(key), F.lit(","), F.lit(2))


def geo_param_text(lat, lng, radius) -> Column:
    """Search parameter ``"lat,long,radius"``."""
    return F.concat_ws(",", _c(lat).cast("string"), _c(lng).cast("string"), _c(radius))


def parse_radius_km(radius) -> Column:
    """``"1mi"`` / ``"2km"`` -> kilometres."""
    r = _c(radius)
    num = F.expr(f"try_cast(regexp_extract({_sql(radius)}, '^([0-9.]+)', 1) as double)")
    return F.when(F.lower(r).endswith("mi"), num * F.lit(1.609344)).otherwise(num)


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name for SQL-expression helpers")
