"""DuckDB SQL twins of the catalogue queries (the correctness oracle).

Each query is a self-contained SQL string over the driver's tables; the
stand-in inputs of :mod:`geoseries.plans.standins` are repeated here as CTEs.
Doubles are rounded to 6 decimals on both sides; every column is aliased to
the Spark name.
"""

from __future__ import annotations

from .standins import NHOOD_KEYS

# ---------------------------------------------------------------------------
# Stand-in CTEs
# ---------------------------------------------------------------------------
NH = """nh AS (
  SELECT n.n_nationkey AS nhood_num, m.n_name AS nhood_name
  FROM nation n LEFT JOIN nation m
    ON m.n_nationkey = CASE WHEN n.n_nationkey = 17 THEN 3 ELSE n.n_nationkey END
)"""

POLY = NH + """,
poly AS (
  SELECT nhood_num AS file_pos, nhood_num, nhood_name,
         CAST(nhood_num AS VARCHAR) || ',' || nhood_name AS key,
         CAST((nhood_num % 5) * 2 AS DOUBLE) AS x0, CAST((nhood_num // 5) * 2 AS DOUBLE) AS y0
  FROM nh
),
edges AS (
  SELECT file_pos, key, x0 AS x1, y0 AS y1, x0 + 2 AS x2, y0 AS y2 FROM poly UNION ALL
  SELECT file_pos, key, x0 + 2, y0, x0 + 2, y0 + 2 FROM poly UNION ALL
  SELECT file_pos, key, x0 + 2, y0 + 2, x0 + 1, y0 + 2 FROM poly UNION ALL
  SELECT file_pos, key, x0 + 1, y0 + 2, x0, y0 + 1 FROM poly UNION ALL
  SELECT file_pos, key, x0, y0 + 1, x0, y0 FROM poly
)"""

CALLS_RAW = POLY + """,
calls_base AS (
  SELECT e.*, nh.nhood_name FROM events e LEFT JOIN nh ON nh.nhood_num = e.user_id % 25
),
calls_raw AS (
  SELECT f.file_seq, CAST(0 AS BIGINT) AS block_start, event_id AS row_seq,
    CASE WHEN event_id >= 1000
         THEN CAST(event_id // 1000 AS VARCHAR) || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')
         ELSE CAST(event_id AS VARCHAR) END AS incident_id,
    strftime(CASE WHEN f.file_seq = 1 THEN ts ELSE ts + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS call_timestamp,
    CASE WHEN f.file_seq = 2 AND event_id % 50 = 1 THEN '2'
         WHEN f.file_seq = 2 AND event_id % 50 = 2 THEN 'P'
         WHEN event_id % 50 = 0 THEN 'P' WHEN event_id % 50 = 1 THEN ' '
         ELSE ' ' || CAST(event_id % 5 + 1 AS VARCHAR) END AS priority,
    CASE WHEN event_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS officerinitiated,
    CASE WHEN event_id % 11 = 0 THEN NULL
         ELSE event_type || ' call ' || CAST(user_id % 7 AS VARCHAR) END AS calldescription,
    CASE WHEN event_id % 17 = 0 THEN 'TOW   ' WHEN event_id % 19 = 0 THEN NULL
         WHEN event_id % 23 = 0 THEN ' HNGUP' ELSE rpad(upper(event_type), 10, ' ') END AS category,
    CASE WHEN event_id % 40 = 0 THEN NULL ELSE nhood_name END AS neighborhood,
    printf('%.2f', ((event_id * 37) % 1100) / 100.0::DOUBLE) AS longitude,
    printf('%.2f', ((event_id * 91) % 1100) / 100.0::DOUBLE) AS latitude,
    printf('%.2f', value - 5) AS dispatchtime,
    printf('%.2f', value) AS totalresponsetime
  FROM calls_base, (VALUES (1), (2)) f(file_seq)
)"""

CALLS_STAGED = CALLS_RAW + """,
staged AS (
  SELECT file_seq, block_start, row_seq,
    TRY_CAST(trim(call_timestamp) AS TIMESTAMP) AS call_timestamp,
    TRY_CAST(replace(trim(incident_id), ',', '') AS BIGINT) AS incident_id,
    trim(officerinitiated) AS officerinitiated,
    TRY_CAST(trim(priority) AS TINYINT) AS priority,
    trim(calldescription) AS calldescription, trim(category) AS category,
    trim(neighborhood) AS neighborhood,
    TRY_CAST(replace(trim(longitude), ',', '') AS DOUBLE) AS longitude,
    TRY_CAST(replace(trim(latitude), ',', '') AS DOUBLE) AS latitude
  FROM calls_raw
  WHERE neighborhood IS NOT NULL
    AND (trim(category) IS NULL OR trim(category) NOT IN ('HNGUP', 'STRTSHFT', 'REMARKS', 'BUS BRD', 'TOW'))
    AND (trim(priority) IS NULL OR trim(priority) NOT IN ('P', ''))
),
calls_first AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY file_seq, block_start, row_seq) AS rn
    FROM staged) WHERE rn = 1
)"""


def pip_sql(points: str, pid: str, px: str, py: str, name: str = "pip") -> str:
    """CTEs ``<name>_hits`` and ``<name>`` (pid, key): first polygon in file order
    that contains the point or has it on its boundary (ray casting over edges)."""
    return f"""{name}_hits AS (
  SELECT p.{pid} AS pid, e.file_pos, e.key,
    sum(CASE WHEN ((e.y1 > p.{py}) <> (e.y2 > p.{py}))
              AND p.{px} < (e.x2 - e.x1) * (p.{py} - e.y1) / NULLIF(e.y2 - e.y1, 0) + e.x1
         THEN 1 ELSE 0 END) AS n,
    bool_or(((e.x2 - e.x1) * (p.{py} - e.y1) - (e.y2 - e.y1) * (p.{px} - e.x1)) = 0
            AND p.{px} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
            AND p.{py} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS onb
  FROM {points} p JOIN edges e ON true
  WHERE p.{px} IS NOT NULL AND p.{py} IS NOT NULL
  GROUP BY p.{pid}, e.file_pos, e.key
),
{name} AS (SELECT pid, arg_min(key, file_pos) AS key FROM {name}_hits WHERE onb OR n % 2 = 1 GROUP BY pid)"""


CALLS_CLEAN = CALLS_STAGED + """,
first_num AS (SELECT nhood_name, min(nhood_num) AS first_num FROM nh GROUP BY nhood_name),
""" + pip_sql("(SELECT * FROM calls_first WHERE neighborhood IN ('NATION_3'))", "incident_id",
              "longitude", "latitude", "calls_pip") + """,
calls_clean AS (
  SELECT c.call_timestamp, c.incident_id, c.officerinitiated, c.priority, c.calldescription,
         c.category, c.neighborhood, c.longitude, c.latitude,
         CASE WHEN c.neighborhood IN ('NATION_3') THEN p.key
              ELSE CAST(f.first_num AS VARCHAR) || ',' || c.neighborhood END AS FID_nhood
  FROM calls_first c
  LEFT JOIN calls_pip p ON p.pid = c.incident_id AND c.neighborhood IN ('NATION_3')
  LEFT JOIN first_num f ON f.nhood_name = c.neighborhood
),
calls AS (SELECT * FROM calls_clean WHERE FID_nhood IS NOT NULL)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def grid_sql(present: str, key: str, step: str = "INTERVAL 3 HOUR", keys: str | None = None) -> str:
    """Dense (key, bin) grid CTE body from a (key, bin) table: union of each
    key's first..last run, every key x every grid bin."""
    keys = keys or f"(SELECT DISTINCT {key} FROM {present})"
    return f"""(SELECT g.bin, k.{key} FROM
      (SELECT DISTINCT unnest(generate_series(f, l, {step})) AS bin
       FROM (SELECT {key}, min(bin) AS f, max(bin) AS l FROM {present} GROUP BY {key})) g
      CROSS JOIN {keys} k)"""


Q: dict[str, str] = {}

Q["attention_level"] = with_(CALLS_CLEAN + """,
b AS (SELECT time_bucket(INTERVAL 3 HOUR, call_timestamp) AS bin, FID_nhood, incident_id, priority
      FROM calls WHERE call_timestamp IS NOT NULL),
present AS (SELECT FID_nhood, bin, count(DISTINCT incident_id) AS n, avg(priority) AS avg_value
            FROM b GROUP BY FID_nhood, bin),
grid AS """ + grid_sql("present", "FID_nhood"), """
SELECT grid.bin, grid.FID_nhood, coalesce(n, 0) AS n, round(coalesce(avg_value, 0), 6) AS avg_value,
       round(coalesce(n, 0) / (coalesce(avg_value, 0) + 1) + 1, 6) AS att_level
FROM grid LEFT JOIN present USING (FID_nhood, bin)""")

Q["clean_calls"] = with_(CALLS_CLEAN, """
SELECT call_timestamp, incident_id, officerinitiated, CAST(priority AS BIGINT) AS priority, calldescription,
       category, neighborhood, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, FID_nhood
FROM calls""")

POSTS_RAW = """posts_raw AS (
  SELECT CAST(doc_id % 2 + 1 AS INT) AS file_seq, CAST(0 AS BIGINT) AS block_start, doc_id AS row_seq,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 37) % 43200 AS BIGINT))
             + to_seconds(CAST(doc_id % 60 AS BIGINT)), '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
    md5(text) AS id_str, text, 'u' || CAST(doc_id % 97 AS VARCHAR) AS "user",
    (['Twitter for iPhone', 'Instagram', 'Foursquare', 'Tweetlogix', 'Untappd', 'Twitter for Android',
      'TweetMyJOBS', 'Paper.li', 'dlvr.it', 'IFTTT'])[(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 10) + 1]
      AS source,
    CASE WHEN doc_id % 9 = 0 THEN NULL
         ELSE '[' || printf('%.2f', ((doc_id * 37) % 1100) / 100.0::DOUBLE) || ', '
                  || printf('%.2f', ((doc_id * 53) % 1100) / 100.0::DOUBLE) || ']' END AS coordinates
  FROM documents
),
post_points AS (
  SELECT *, CAST(json_extract(coordinates, '$[0]') AS DOUBLE) AS lng,
            CAST(json_extract(coordinates, '$[1]') AS DOUBLE) AS lat
  FROM posts_raw
)"""

POSTS_CLEAN = POLY + ",\n" + POSTS_RAW + """,
posts_f1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY file_seq, id_str ORDER BY block_start, row_seq) AS rn
    FROM post_points) WHERE rn = 1
),
posts_geo AS (SELECT * FROM posts_f1 WHERE coordinates IS NOT NULL),
""" + pip_sql("posts_geo", "row_seq", "lng", "lat", "posts_pip") + """,
posts_kept AS (
  SELECT g.*, p.key AS FID_nhood FROM posts_geo g JOIN posts_pip p ON p.pid = g.row_seq
  WHERE g.source IS NOT NULL AND (contains(g.source, 'Instagram') OR contains(g.source, 'Twitter for Android')
     OR contains(g.source, 'Twitter for iPhone') OR contains(g.source, 'Foursquare')
     OR contains(g.source, 'Tweetlogix') OR contains(g.source, 'Untappd'))
),
posts_once AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id_str ORDER BY file_seq, block_start, row_seq) AS rn
    FROM posts_kept) WHERE rn = 1
),
posts AS (
  SELECT timezone('UTC', strptime(substr(created_at, 5), '%b %d %H:%M:%S %z %Y')) AS created_at,
         id_str, text, "user", source, lng, lat, FID_nhood
  FROM posts_once
)"""

Q["dedupe_keep_first"] = with_(CALLS_STAGED, """
SELECT incident_id, CAST(file_seq AS BIGINT) AS file_seq, call_timestamp, CAST(priority AS BIGINT) AS priority
FROM calls_first""")

Q["clean_posts_two_phase"] = with_(POSTS_CLEAN, """
SELECT created_at, id_str, "user", source, round(lng, 6) AS lng, round(lat, 6) AS lat, FID_nhood,
       CAST(length(text) AS BIGINT) AS text_len
FROM posts""")

_OKC = "(trim(category) IS NULL OR trim(category) NOT IN ('HNGUP', 'STRTSHFT', 'REMARKS', 'BUS BRD', 'TOW'))"
_OKP = "(trim(priority) IS NULL OR trim(priority) NOT IN ('P', ''))"
Q["stage_audit"] = with_(CALLS_RAW, f"""
SELECT CAST(file_seq AS BIGINT) AS file_seq, count(*) AS raw_rows,
       count(*) FILTER (WHERE neighborhood IS NOT NULL) AS with_nhood,
       count(*) FILTER (WHERE neighborhood IS NOT NULL AND {_OKC}) AS category_kept,
       count(*) FILTER (WHERE neighborhood IS NOT NULL AND {_OKC} AND {_OKP}) AS kept,
       CAST(0 AS BIGINT) AS with_rejects
FROM calls_raw GROUP BY file_seq""")

_RAW_COLS = ["call_timestamp", "incident_id", "officerinitiated", "priority", "calldescription",
             "category", "neighborhood", "longitude", "latitude", "dispatchtime", "totalresponsetime"]
Q["null_share"] = with_(CALLS_RAW, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS null_pct "
    f"FROM calls_raw" for c in _RAW_COLS))

_STAGED_COLS = ["call_timestamp", "incident_id", "officerinitiated", "priority", "calldescription",
                "category", "neighborhood", "longitude", "latitude"]
_STAGED_TYPES = {"call_timestamp": "timestamp_ntz", "incident_id": "bigint", "priority": "tinyint", "longitude": "double", "latitude": "double"}
Q["column_profile"] = with_(CALLS_STAGED, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{_STAGED_TYPES.get(c, 'string')}' AS dtype, count({c}) AS non_null, count(*) AS \"rows\" FROM staged" for c in _STAGED_COLS))

Q["value_counts"] = with_(CALLS_CLEAN, """
SELECT category, count(*) AS "count" FROM calls WHERE category IS NOT NULL GROUP BY category""")

Q["value_shares"] = with_(CALLS_CLEAN, """
SELECT CAST(priority AS BIGINT) AS priority, "count", round("count" * 100.0 / sum("count") OVER (), 6) AS share
FROM (SELECT priority, count(*) AS "count" FROM calls WHERE priority IS NOT NULL GROUP BY priority)""")

Q["top_categories"] = with_(CALLS_CLEAN, """
SELECT category, "count" FROM (SELECT category, count(*) AS "count" FROM calls WHERE category IS NOT NULL
GROUP BY category ORDER BY "count" DESC, category LIMIT 10)""")

Q["top10_per_priority"] = with_(CALLS_CLEAN, """
SELECT * FROM (
  SELECT CAST(priority AS BIGINT) AS priority, category, "count",
         row_number() OVER (PARTITION BY priority ORDER BY "count" DESC, category) AS "rank",
         round("count" * 100.0 / sum("count") OVER (PARTITION BY priority), 6) AS share
  FROM (SELECT priority, category, count(*) AS "count" FROM calls WHERE category IS NOT NULL
        GROUP BY priority, category)) WHERE "rank" <= 10""")

EDA = CALLS_RAW + """,
eda AS (
  SELECT file_seq, block_start, row_seq, trim(priority) AS priority, trim(category) AS category,
         trim(calldescription) AS calldescription, trim(officerinitiated) AS officerinitiated,
         TRY_CAST(replace(dispatchtime, ',', '') AS DOUBLE) AS dispatchtime,
         TRY_CAST(replace(totalresponsetime, ',', '') AS DOUBLE) AS totalresponsetime
  FROM calls_raw
)"""

Q["first_description"] = with_(EDA, """
SELECT category, first(calldescription ORDER BY file_seq, block_start, row_seq)
       FILTER (WHERE calldescription IS NOT NULL) AS calldescription
FROM eda GROUP BY category""")

Q["box_stats"] = with_(EDA + """,
d AS (SELECT priority, dispatchtime AS v FROM eda WHERE officerinitiated = 'No' AND dispatchtime >= 0),
q AS (SELECT priority, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM d GROUP BY priority)""", """
SELECT q.priority, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
       round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM q JOIN d USING (priority) GROUP BY q.priority, q.n, q1, median, q3""")

Q["histogram60"] = with_(EDA + """,
d AS (SELECT totalresponsetime AS v FROM eda WHERE totalresponsetime IS NOT NULL AND totalresponsetime < 60),
mm AS (SELECT min(v) AS lo, max(v) AS hi FROM d),
b AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 60) AS BIGINT) + 1, 60) AS bucket, lo, hi FROM d, mm)""", """
SELECT bucket, round(lo + (bucket - 1) * ((hi - lo) / 60), 6) AS lo, round(lo + bucket * ((hi - lo) / 60), 6) AS hi,
       count(*) AS "count"
FROM b GROUP BY bucket, b.lo, b.hi""")

Q["last_rows"] = with_(CALLS_CLEAN, """
SELECT call_timestamp, incident_id, FID_nhood FROM calls
ORDER BY call_timestamp DESC NULLS LAST, incident_id DESC LIMIT 5""")

Q["time_filter"] = with_(CALLS_CLEAN, """
SELECT incident_id, call_timestamp, FID_nhood FROM calls
WHERE call_timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND call_timestamp < TIMESTAMP '2024-01-17 00:00:00'""")

Q["last_30_days"] = with_(CALLS_CLEAN, """
SELECT incident_id, call_timestamp FROM calls
WHERE call_timestamp >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY
  AND call_timestamp < TIMESTAMP '2024-01-31 00:00:00'""")

Q["bbox_filter"] = with_(POSTS_RAW, """
SELECT row_seq, round(lng, 6) AS lng, round(lat, 6) AS lat FROM post_points
WHERE lng BETWEEN 1.0 AND 9.0 AND lat BETWEEN 1.0 AND 9.0""")

Q["radius_match"] = with_(POLY + ",\n" + POSTS_RAW + """,
centres AS (SELECT CAST(y0 + 1 AS VARCHAR) || ',' || CAST(x0 + 1 AS VARCHAR) AS centre,
                   y0 + 1 AS clat, x0 + 1 AS clng, 60.0 AS rkm FROM poly)""", """
SELECT p.row_seq, c.centre, c.centre || ',60km' AS query_geo FROM post_points p JOIN centres c ON true
WHERE 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(c.clat - p.lat) / 2), 2)
      + cos(radians(p.lat)) * cos(radians(c.clat)) * pow(sin(radians(c.clng - p.lng) / 2), 2)))) <= c.rkm""")

_B3 = """,
b AS (SELECT time_bucket(INTERVAL 3 HOUR, call_timestamp) AS bin, * FROM calls WHERE call_timestamp IS NOT NULL)"""

Q["time_count"] = with_(CALLS_CLEAN + _B3 + """,
keys AS (SELECT * FROM (VALUES ('0,NATION_0'), ('3,NATION_3'), ('17,NATION_3'), ('99,NOWHERE')) k(FID_nhood)),
present AS (SELECT FID_nhood, bin, count(DISTINCT incident_id) AS value FROM b
            WHERE FID_nhood IN (SELECT FID_nhood FROM keys) GROUP BY FID_nhood, bin),
grid AS """ + grid_sql("present", "FID_nhood", keys="keys"), """
SELECT grid.bin, grid.FID_nhood, coalesce(value, 0) AS value FROM grid LEFT JOIN present USING (FID_nhood, bin)""")

Q["time_avg"] = with_(CALLS_CLEAN + _B3 + """,
present AS (SELECT FID_nhood, bin, avg(priority) AS value FROM b GROUP BY FID_nhood, bin),
grid AS """ + grid_sql("present", "FID_nhood"), """
SELECT grid.bin, grid.FID_nhood, round(coalesce(value, 0), 6) AS value FROM grid LEFT JOIN present USING (FID_nhood, bin)""")

Q["bin_grid_gaps"] = with_(CALLS_CLEAN + """,
o AS (SELECT FID_nhood, date_trunc('day', min(call_timestamp)) AS d0 FROM calls
      WHERE call_timestamp IS NOT NULL GROUP BY FID_nhood),
b AS (SELECT c.*, o.d0 + to_seconds(CAST(floor(date_diff('microsecond', o.d0, c.call_timestamp) / 18000000000.0)
                                         * 18000 AS BIGINT)) AS bin
      FROM calls c JOIN o USING (FID_nhood) WHERE c.call_timestamp IS NOT NULL),
present AS (SELECT FID_nhood, bin, count(DISTINCT incident_id) AS value FROM b GROUP BY FID_nhood, bin),
grid AS """ + grid_sql("present", "FID_nhood", step="INTERVAL 5 HOUR"), """
SELECT grid.bin, grid.FID_nhood, coalesce(value, 0) AS value FROM grid LEFT JOIN present USING (FID_nhood, bin)""")

TC_ALL = CALLS_CLEAN + _B3 + """,
present AS (SELECT FID_nhood, bin, count(DISTINCT incident_id) AS value FROM b GROUP BY FID_nhood, bin),
grid AS """ + grid_sql("present", "FID_nhood") + """,
tc AS (SELECT grid.bin, grid.FID_nhood, coalesce(value, 0) AS value FROM grid LEFT JOIN present USING (FID_nhood, bin))"""

Q["city_total"] = with_(TC_ALL, "SELECT bin, CAST(sum(value) AS BIGINT) AS total FROM tc GROUP BY bin")

AL = CALLS_CLEAN + _B3 + """,
present AS (SELECT FID_nhood, bin, count(DISTINCT incident_id) AS n, avg(priority) AS avg_value
            FROM b GROUP BY FID_nhood, bin),
grid AS """ + grid_sql("present", "FID_nhood") + """,
al AS (SELECT grid.bin, grid.FID_nhood, round(coalesce(n, 0) / (coalesce(avg_value, 0) + 1) + 1, 6) AS att_level
       FROM grid LEFT JOIN present USING (FID_nhood, bin))"""

Q["wide_series"] = with_(AL, "SELECT bin, " + ", ".join(
    f"max(att_level) FILTER (WHERE FID_nhood = '{k}') AS \"{k}\"" for k in NHOOD_KEYS) + " FROM al GROUP BY bin")
Q["unpivot_series"] = with_(AL, "SELECT bin, FID_nhood, att_level FROM al")

Q["point_in_polygon"] = with_(CALLS_STAGED + ",\n" + pip_sql("calls_first", "incident_id", "longitude",
                                                           "latitude", "pp"), """
SELECT c.incident_id, p.key FROM calls_first c LEFT JOIN pp p ON p.pid = c.incident_id""")

Q["selective_relabel"] = with_(CALLS_CLEAN, """
SELECT incident_id, neighborhood, FID_nhood FROM calls_clean""")

Q["nhood_num_list"] = with_(NH, """
SELECT nhood_name, string_agg(CAST(nhood_num AS VARCHAR), ',' ORDER BY nhood_num) AS nums,
       CAST(min(nhood_num) AS BIGINT) AS first_num
FROM nh GROUP BY nhood_name""")

ADJ = POLY + """,
sp AS (
  SELECT a.file_pos AS pa, b.file_pos AS pb,
    sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) AS o1,
    sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS o2,
    sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) AS o3,
    sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS o4,
    b.x1 BETWEEN least(a.x1, a.x2) AND greatest(a.x1, a.x2) AND b.y1 BETWEEN least(a.y1, a.y2) AND greatest(a.y1, a.y2) AS b1_on_a,
    b.x2 BETWEEN least(a.x1, a.x2) AND greatest(a.x1, a.x2) AND b.y2 BETWEEN least(a.y1, a.y2) AND greatest(a.y1, a.y2) AS b2_on_a,
    a.x1 BETWEEN least(b.x1, b.x2) AND greatest(b.x1, b.x2) AND a.y1 BETWEEN least(b.y1, b.y2) AND greatest(b.y1, b.y2) AS a1_on_b,
    a.x2 BETWEEN least(b.x1, b.x2) AND greatest(b.x1, b.x2) AND a.y2 BETWEEN least(b.y1, b.y2) AND greatest(b.y1, b.y2) AS a2_on_b
  FROM edges a JOIN edges b ON a.file_pos <> b.file_pos
),
bnd AS (
  SELECT pa, pb,
    bool_or((o1 <> o2 AND o3 <> o4) OR (o1 = 0 AND b1_on_a) OR (o2 = 0 AND b2_on_a)
            OR (o3 = 0 AND a1_on_b) OR (o4 = 0 AND a2_on_b)) AS meet,
    bool_or(o1 * o2 < 0 AND o3 * o4 < 0) AS crosses
  FROM sp GROUP BY pa, pb
),
probe AS (
  SELECT file_pos, x1 AS px, y1 AS py FROM edges UNION ALL
  SELECT file_pos, (x1 + x2) / 2, (y1 + y2) / 2 FROM edges
),
ins AS (
  SELECT pa, pb FROM (
    SELECT q.file_pos AS pa, e.file_pos AS pb, q.px, q.py,
      sum(CASE WHEN ((e.y1 > q.py) <> (e.y2 > q.py))
                AND q.px < (e.x2 - e.x1) * (q.py - e.y1) / NULLIF(e.y2 - e.y1, 0) + e.x1 THEN 1 ELSE 0 END) AS n,
      bool_or(((e.x2 - e.x1) * (q.py - e.y1) - (e.y2 - e.y1) * (q.px - e.x1)) = 0
              AND q.px BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
              AND q.py BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS onb
    FROM probe q JOIN edges e ON q.file_pos <> e.file_pos
    GROUP BY q.file_pos, e.file_pos, q.px, q.py)
  WHERE NOT onb AND n % 2 = 1
),
adj AS (
  SELECT ka.key AS centre, kb.key AS neighbour, bnd.pa, bnd.pb
  FROM bnd JOIN poly ka ON ka.file_pos = bnd.pa JOIN poly kb ON kb.file_pos = bnd.pb
  WHERE meet AND NOT crosses
    AND NOT EXISTS (SELECT 1 FROM ins WHERE ins.pa = bnd.pa AND ins.pb = bnd.pb)
    AND NOT EXISTS (SELECT 1 FROM ins WHERE ins.pa = bnd.pb AND ins.pb = bnd.pa)
)"""

Q["adjacency"] = with_(ADJ, "SELECT centre, neighbour FROM adj")

Q["name_reconcile"] = with_(CALLS_RAW + """,
pn AS (SELECT DISTINCT nhood_name AS name FROM nh),
rn AS (SELECT DISTINCT neighborhood AS name FROM calls_raw WHERE neighborhood IS NOT NULL)""", """
SELECT name, 'only_in_boundaries' AS issue, CAST(1 AS BIGINT) AS n FROM pn WHERE name NOT IN (SELECT name FROM rn)
UNION ALL
SELECT name, 'only_in_records', 1 FROM rn WHERE name NOT IN (SELECT name FROM pn)
UNION ALL
SELECT nhood_name, 'duplicate_name', count(*) FROM nh GROUP BY nhood_name HAVING count(*) > 1""")

Q["outside_audit"] = with_(CALLS_STAGED + ",\n" + pip_sql("calls_first", "incident_id", "longitude",
                                                        "latitude", "pp"), """
SELECT count(*) AS "rows",
       count(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL) AS no_coords,
       count(*) FILTER (WHERE NOT (longitude BETWEEN 0.0 AND 10.0 AND latitude BETWEEN 0.0 AND 10.0)) AS outside_box,
       count(*) FILTER (WHERE neighborhood IS NULL) AS null_name,
       count(*) FILTER (WHERE p.key IS NULL) AS in_no_polygon
FROM calls_first c LEFT JOIN pp p ON p.pid = c.incident_id""")

Q["neighbour_total"] = with_(TC_ALL + ",\n" + ADJ[len(POLY) + 2:], """
SELECT tc.bin, adj.centre, CAST(sum(tc.value) AS BIGINT) AS adj_total
FROM tc JOIN adj ON adj.neighbour = tc.FID_nhood GROUP BY tc.bin, adj.centre""")

# ---- series ------------------------------------------------------------------------------
SERIES = """ev_b AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) AS bin, event_type AS series, event_id
         FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
ev_present AS (SELECT series, bin, count(DISTINCT event_id) AS value FROM ev_b GROUP BY series, bin),
ev_grid AS """ + grid_sql("ev_present", "series") + """,
series AS (SELECT g.series, g.bin, CAST(coalesce(p.value, 0) AS DOUBLE) AS value
           FROM ev_grid g LEFT JOIN ev_present p USING (series, bin))"""


def _autocov_sql(k_max: int) -> str:
    lags = ", ".join(f"lag(xc, {k}) OVER (PARTITION BY series ORDER BY bin) AS l{k}" for k in range(1, k_max + 1))
    sums = ", ".join(f"sum(xc * l{k}) AS s{k}" for k in range(1, k_max + 1))
    return SERIES + f""",
c AS (SELECT series, bin, value - avg(value) OVER (PARTITION BY series) AS xc FROM series),
l AS (SELECT series, xc, {lags} FROM c),
s AS (SELECT series, count(*) AS n, sum(xc * xc) AS s0, {sums} FROM l GROUP BY series)"""


ACF8 = _autocov_sql(8) + ",\nacf AS (" + "\nUNION ALL\n".join(
    f"SELECT series, CAST({k} AS BIGINT) AS lag, abs(s{k} / NULLIF(s0, 0)) AS acf FROM s" for k in range(0, 9)) + ")"

Q["acf"] = with_(ACF8, "SELECT series, lag, round(acf, 6) AS acf FROM acf")

Q["best_lag"] = with_(ACF8, """
SELECT series, lag, round(acf, 6) AS acf FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY acf DESC, lag) AS rn
  FROM acf WHERE lag >= 1 AND acf IS NOT NULL) WHERE rn = 1""")

Q["pacf"] = with_(_autocov_sql(3) + """,
r AS (SELECT series, (s1 / (n - 1)) / (s0 / n) AS r1, (s2 / (n - 2)) / (s0 / n) AS r2,
             (s3 / (n - 3)) / (s0 / n) AS r3 FROM s),
p1 AS (SELECT *, (r1 - 0.0) / (1.0 - 0.0) AS f11 FROM r),
p2 AS (SELECT *, (r2 - (0.0 + f11 * r1)) / (1.0 - (0.0 + f11 * r1)) AS f22 FROM p1),
p3 AS (SELECT *, f11 - f22 * f11 AS f21 FROM p2),
p4 AS (SELECT *, (r3 - ((0.0 + f21 * r2) + f22 * r1)) / (1.0 - ((0.0 + f21 * r1) + f22 * r2)) AS f33 FROM p3)""", """
SELECT series, CAST(0 AS BIGINT) AS lag, 1.0 AS pacf FROM p4 UNION ALL
SELECT series, 1, round(abs(f11), 6) FROM p4 UNION ALL
SELECT series, 2, round(abs(f22), 6) FROM p4 UNION ALL
SELECT series, 3, round(abs(f33), 6) FROM p4""")

Q["decompose"] = with_(SERIES + """,
t AS (SELECT series, bin, value, row_number() OVER w - 1 AS idx, lag(value, 4) OVER w AS lo,
             lead(value, 4) OVER w AS hi,
             sum(value) OVER (PARTITION BY series ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s
      FROM series WINDOW w AS (PARTITION BY series ORDER BY bin)),
tr AS (SELECT *, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (s - 0.5 * lo - 0.5 * hi) / 8 END AS trend,
              idx % 8 AS phase FROM t),
pm AS (SELECT series, phase, avg(value - trend) AS pm FROM tr GROUP BY series, phase),
pmean AS (SELECT series, avg(pm ORDER BY phase) AS pmean FROM pm GROUP BY series)""", """
SELECT tr.series, tr.bin, round(value, 6) AS observed, round(trend, 6) AS trend,
       round(pm.pm - pmean.pmean, 6) AS seasonal, round(value - trend - (pm.pm - pmean.pmean), 6) AS resid
FROM tr JOIN pm USING (series, phase) JOIN pmean USING (series)""")

LAGROWS = SERIES + """,
lr_all AS (SELECT series, bin, row_number() OVER w - 1 - 3 AS row_idx, lag(value, 3) OVER w AS x_1,
                  lag(value, 2) OVER w AS x_2, lag(value, 1) OVER w AS x_3, value AS y
           FROM series WINDOW w AS (PARTITION BY series ORDER BY bin)),
lr AS (SELECT * FROM lr_all WHERE row_idx >= 0)"""

Q["lag_rows"] = with_(LAGROWS, "SELECT series, row_idx, bin, x_1, x_2, x_3, y FROM lr")


def _split_sql(key: str, src: str) -> str:
    return f"""(SELECT {key}, CASE WHEN rn > n - n_test THEN 'test'
                       WHEN rn > n - n_test - CAST(ceil((n - n_test) * 0.2) AS BIGINT) THEN 'validation'
                       ELSE 'train' END AS split
   FROM (SELECT {key}, row_number() OVER (ORDER BY {key}) AS rn, count(*) OVER () AS n,
                CAST(ceil(count(*) OVER () * 0.2) AS BIGINT) AS n_test
         FROM (SELECT DISTINCT {key} FROM {src})))"""


Q["split3"] = with_(SERIES + ",\nlab AS " + _split_sql("bin", "series"),
                    "SELECT series, bin, split FROM series JOIN lab USING (bin)")

TSPLIT = LAGROWS + ",\nlab AS " + _split_sql("row_idx", "lr") + """,
lrs AS (SELECT * FROM lr JOIN lab USING (row_idx))"""
Q["tabular_split"] = with_(TSPLIT, "SELECT series, row_idx, split FROM lrs")

Q["series_index"] = with_(SERIES, """
SELECT series, row_number() OVER (ORDER BY f, series) - 1 AS idx FROM (SELECT series, min(bin) AS f FROM series GROUP BY series)""")

Q["losses"] = with_(SERIES + """,
d AS (SELECT series, value, lag(value, 8) OVER (PARTITION BY series ORDER BY bin) AS pred FROM series)""", """
SELECT series, round(avg(abs(value - pred)), 6) AS mae, round(avg(pow(value - pred, 2)), 6) AS mse,
       round(avg(abs(value - pred) / NULLIF(abs(value), 0)) * 100, 6) AS mape,
       round(avg(abs(value - pred) / NULLIF(abs(value) + abs(pred), 0)) * 100, 6) AS smape,
       count(*) FILTER (WHERE value = 0) AS zero_denominators
FROM d WHERE pred IS NOT NULL GROUP BY series""")

_W = "(1.0 / 3)"
_F = f"(0.0 + (((0.0 + l1 * {_W}) + l2 * {_W}) + l3 * {_W}))"


def _recursive_sql(src: str, key: str) -> str:
    return f"""rec AS (
  WITH RECURSIVE r(series, {key}, step, l1, l2, l3) AS (
    SELECT series, {key}, 1, x_1, x_2, x_3 FROM {src}
    UNION ALL
    SELECT series, {key}, step + 1, l2, l3, {_F} FROM r WHERE step < 8
  )
  SELECT series, {key}, step, {_F} AS pred FROM r
)"""


Q["recursive_mean_model"] = with_(LAGROWS + ",\n" + _recursive_sql("lr", "row_idx"),
                                  "SELECT series, row_idx, CAST(step AS BIGINT) AS step, round(pred, 6) AS pred FROM rec")

_TREE = "CASE WHEN l{0} <= fa THEN lo WHEN l{1} <= fa * 1.2 THEN fa ELSE hi END"
_FOREST = f"((((0.0 + {_TREE.format(1, 2)}) + {_TREE.format(2, 3)}) + {_TREE.format(3, 1)}) / 3)"
Q["forest_recursive"] = with_(LAGROWS + """,
fs AS (SELECT series, round(avg(value), 3) AS fa, min(value) AS lo, max(value) AS hi FROM series GROUP BY series),
lf AS (SELECT lr.*, fa, lo, hi FROM lr JOIN fs USING (series)),
rec AS (
  WITH RECURSIVE r(series, row_idx, step, l1, l2, l3, fa, lo, hi) AS (
    SELECT series, row_idx, 1, x_1, x_2, x_3, fa, lo, hi FROM lf
    UNION ALL
    SELECT series, row_idx, step + 1, l2, l3, """ + _FOREST + """, fa, lo, hi FROM r WHERE step < 8)
  SELECT series, row_idx, step, """ + _FOREST + """ AS pred FROM r)""",
                              "SELECT series, row_idx, CAST(step AS BIGINT) AS step, round(pred, 6) AS pred FROM rec")

Q["backtest"] = with_(TSPLIT + """,
t AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY row_idx) - 1 AS i,
             count(*) OVER (PARTITION BY series) AS n, x_1, x_2, x_3, y FROM lrs WHERE split = 'test'),
o AS (SELECT series, i AS origin, x_1, x_2, x_3 FROM t WHERE i <= n - 8),
""" + _recursive_sql("o", "origin") + """,
per AS (SELECT rec.series, rec.origin, avg(pow(t.y - rec.pred, 2)) AS loss
        FROM rec JOIN t ON t.series = rec.series AND t.i = rec.origin + rec.step - 1
        GROUP BY rec.series, rec.origin)""", """
SELECT series, count(*) AS origins, round(avg(loss), 6) AS loss FROM per GROUP BY series""")

Q["day_map_frame"] = with_(AL + """,
dm AS (SELECT CAST(day(bin) AS BIGINT) AS "Day", CAST(hour(bin) AS BIGINT) AS "Hour", FID_nhood, att_level
       FROM al WHERE day(bin) = 15)""", """
SELECT dm."Day", dm."Hour", dm.att_level, CAST(split_part(FID_nhood, ',', 1) AS BIGINT) AS FID,
       split_part(FID_nhood, ',', 2) AS name,
       min(att_level) OVER (PARTITION BY dm."Day") AS zmin, max(att_level) OVER (PARTITION BY dm."Day") AS zmax,
       printf('Hour %d:00', dm."Hour") AS label,
       EXISTS (SELECT 1 FROM poly WHERE poly.nhood_num = CAST(split_part(FID_nhood, ',', 1) AS BIGINT)) AS has_geometry
FROM dm""")


def _src_sql(name: str, table: str, key: str, ts: str, idc: str) -> str:
    return f"""src_{name} AS (SELECT {key} AS k, time_bucket(INTERVAL 3 HOUR, {ts}) AS bin, {idc} AS id
               FROM {table} WHERE {key} IS NOT NULL AND {ts} IS NOT NULL),
cnt_{name} AS (SELECT k, bin, count(DISTINCT id) AS n FROM src_{name} GROUP BY k, bin),
span_{name} AS (SELECT k, unnest(generate_series(min(bin), max(bin), INTERVAL 3 HOUR)) AS bin
                FROM cnt_{name} GROUP BY k)"""


_WS_NAMES = ["calls", "tweets", "users"]
Q["working_series"] = with_(
    CALLS_CLEAN + ",\n" + POSTS_CLEAN[len(POLY) + 2:] + ",\n" + ADJ[len(POLY) + 2:] + ",\n"
    + _src_sql("calls", "calls", "FID_nhood", "call_timestamp", "incident_id") + ",\n"
    + _src_sql("tweets", "posts", "FID_nhood", "created_at", "id_str") + ",\n"
    + _src_sql("users", "posts", "FID_nhood", "created_at", '"user"') + """,
keys AS (""" + "\nUNION\n".join(
        f"SELECT k AS centre, bin FROM span_{n} UNION SELECT adj.centre, s.bin FROM span_{n} s "
        f"JOIN adj ON adj.neighbour = s.k" for n in _WS_NAMES) + ")", """
SELECT keys.centre, keys.bin,
""" + ",\n".join(
        f"  coalesce((SELECT n FROM cnt_{n} c WHERE c.k = keys.centre AND c.bin = keys.bin), 0) AS {n},\n"
        f"  coalesce((SELECT CAST(sum(c.n) AS BIGINT) FROM cnt_{n} c JOIN adj ON adj.neighbour = c.k "
        f"WHERE adj.centre = keys.centre AND c.bin = keys.bin), 0) AS {n}_adj" for n in _WS_NAMES) + """
FROM keys""")

# ---- landed pages and statuses -----------------------------------------------------------
Q["page_merge"] = """
SELECT CAST(event_id // 500 + 1 AS BIGINT) AS page_no, event_id AS incident_id, upper(event_type) AS category,
       CAST(event_id % 5 + 1 AS VARCHAR) AS priority,
       timezone('America/New_York', to_timestamp(ms // 1000) + to_milliseconds(ms % 1000)) AS call_timestamp_EST
FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"""

Q["page_audit"] = """
SELECT page_no, 'ok' AS page_class, "rows", page_no < max(page_no) OVER () AS more,
       CAST(coalesce(sum("rows") OVER (ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS "offset",
       true AS consistent
FROM (SELECT CAST(event_id // 500 + 1 AS BIGINT) AS page_no, count(*) AS "rows" FROM events GROUP BY 1)"""

Q["geojson_flatten"] = with_(POLY, """
SELECT CAST(nhood_num // 10 + 1 AS BIGINT) AS page_no,
       row_number() OVER (PARTITION BY nhood_num // 10 ORDER BY nhood_num) - 1 AS feature_pos,
       CAST(nhood_num AS BIGINT) AS FID, nhood_name, 'Polygon' AS geometry_type, key, CAST(6 AS BIGINT) AS n_points,
       x0 AS minx, y0 AS miny, x0 + 2 AS maxx, y0 + 2 AS maxy
FROM poly""")

STATUS_BASE = """sd AS (
  SELECT e.event_id, e.ts, e.event_type, e.props, c.c_custkey, c.c_name, c.c_mktsegment, c.c_acctbal,
         c.c_nationkey, n.n_name,
         ((e.event_id * 37) % 1100) / 100.0::DOUBLE AS lng, ((e.event_id * 91) % 1100) / 100.0::DOUBLE AS lat
  FROM events e LEFT JOIN customer c ON e.user_id + 1 = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""
_PROV = "TIMESTAMP '2024-02-01 00:00:00' AS query_time, '5.0,5.0,60km' AS query_geo"

Q["status_tweet"] = with_(STATUS_BASE, f"""
SELECT {_PROV}, strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at, CAST(event_id AS VARCHAR) AS id_str,
       event_type || ' ' || props AS text,
       CASE WHEN event_id % 13 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS "user",
       'Twitter for Android' AS source, false AS truncated, CAST(NULL AS VARCHAR) AS in_reply_to_status_id_str,
       CAST(NULL AS VARCHAR) AS in_reply_to_user_id_str, event_id % 6 = 0 AS is_quote_status,
       event_id % 9 AS retweet_count, event_id % 8 AS favorite_count, false AS favorited, false AS retweeted,
       'en' AS lang,
       CASE WHEN event_id % 4 <> 0 THEN '[' || CAST(lng AS VARCHAR) || ', ' || CAST(lat AS VARCHAR) || ']' END
         AS coordinates,
       (event_id % 5 = 0 AND n_name IS NOT NULL) AS has_place
FROM sd""")

Q["status_user"] = with_(STATUS_BASE, f"""
SELECT {_PROV}, CAST(c_custkey AS VARCHAR) AS id_str, c_name AS name, lower(c_name) AS screen_name,
       c_mktsegment AS location, CAST(NULL AS VARCHAR) AS url, 'balance ' || printf('%.2f', c_acctbal) AS description,
       c_acctbal < 0 AS protected, c_nationkey % 2 = 0 AS verified, c_custkey * 3 AS followers_count,
       c_custkey % 100 AS friends_count, c_custkey % 7 AS listed_count, c_custkey % 50 AS favourites_count,
       c_custkey * 11 AS statuses_count, 'Mon Jan 01 00:00:00 +0000 2018' AS created_at,
       c_custkey % 3 = 0 AS default_profile, false AS default_profile_image, c_custkey % 2 = 1 AS geo_enabled
FROM sd WHERE event_id % 13 <> 0""")

Q["status_place"] = with_(STATUS_BASE, f"""
SELECT {_PROV}, 'p' || CAST(c_nationkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS url, 'city' AS place_type,
       n_name AS name, n_name || ', XX' AS full_name, 'XX' AS country_code, 'Testland' AS country,
       CAST(2 AS BIGINT) AS box_points
FROM sd WHERE event_id % 5 = 0 AND n_name IS NOT NULL""")

# ---- streaming ---------------------------------------------------------------------------
_IN_BOX = "event_id % 4 <> 0 AND lng BETWEEN 0.0 AND 10.0 AND lat BETWEEN 0.0 AND 10.0"
_TWEET_COLS = Q["status_tweet"].split("\nSELECT ", 1)[1].rsplit("\nFROM sd", 1)[0]
Q["stream_statuses_once"] = with_(STATUS_BASE + f""",
tw AS (SELECT {_TWEET_COLS} FROM sd WHERE {_IN_BOX})""", "SELECT * FROM tw UNION ALL SELECT * FROM tw")

Q["stream_total_once"] = with_(STATUS_BASE, f"SELECT 2 * count(*) AS statuses FROM sd WHERE {_IN_BOX}")

Q["stream_bin_once"] = with_(STATUS_BASE, f"""
SELECT time_bucket(INTERVAL 3 HOUR, date_trunc('second', ts)) AS bin, count(DISTINCT event_id) AS n
FROM sd WHERE {_IN_BOX} GROUP BY 1""")

Q["stream_bin_nhood"] = with_(POLY + ",\n" + STATUS_BASE + f""",
sp AS (SELECT event_id, ts, lng, lat FROM sd WHERE {_IN_BOX}),
""" + pip_sql("sp", "event_id", "lng", "lat"), """
SELECT time_bucket(INTERVAL 3 HOUR, date_trunc('second', ts)) AS bin, pip.key AS FID_nhood, count(DISTINCT event_id) AS n
FROM sp LEFT JOIN pip ON pip.pid = event_id GROUP BY 1, 2""")

# ---- file round trips ----------------------------------------------------------------
Q["csv_scan_keep_first"] = with_(CALLS_STAGED, """
SELECT incident_id, call_timestamp, CAST(priority AS BIGINT) AS priority FROM calls_first""")

Q["polygon_scan"] = with_(POLY, """
SELECT key, CAST(nhood_num AS BIGINT) AS nhood_num, nhood_name, CAST(6 AS BIGINT) AS n_points,
       x0 AS minx, y0 AS miny, x0 + 2 AS maxx, y0 + 2 AS maxy, true AS valid FROM poly""")

Q["clean_table_roundtrip"] = Q["clean_calls"]

Q["sink_order"] = with_(CALLS_CLEAN, """
SELECT row_number() OVER (ORDER BY call_timestamp NULLS LAST, incident_id) - 1 AS position, incident_id, call_timestamp FROM calls""")

Q["geojson_sink_roundtrip"] = with_(NH, """
SELECT CAST(nhood_num AS BIGINT) AS FID, nhood_name, 'Polygon' AS geometry_type FROM nh""")

Q["wide_forecast_scan"] = Q["day_map_frame"]

Q["distinct_counts"] = with_(CALLS_CLEAN, """
SELECT count(DISTINCT category) AS category, count(DISTINCT FID_nhood) AS FID_nhood,
       count(DISTINCT incident_id) AS incident_id FROM calls""")

Q["last_n_rows"] = with_(SERIES, """
SELECT series, bin, value FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY bin DESC) AS rn FROM series) WHERE rn <= 160""")

Q["last_fraction_rows"] = with_(SERIES, """
SELECT series, bin, value FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY bin DESC) AS rn, count(*) OVER (PARTITION BY series) AS n
  FROM series) WHERE rn <= CAST(floor(n * 0.25) AS BIGINT)""")

Q["posts_stage_audit"] = with_(POSTS_CLEAN + """,
f1_all AS (SELECT f.*, p.key FROM posts_f1 f LEFT JOIN posts_pip p ON p.pid = f.row_seq AND f.coordinates IS NOT NULL),
stages AS (
  SELECT file_seq, count(*) AS unique_rows, count(*) FILTER (WHERE coordinates IS NOT NULL) AS geo_tagged,
         count(*) FILTER (WHERE coordinates IS NOT NULL AND key IS NOT NULL) AS in_area,
         count(*) FILTER (WHERE coordinates IS NOT NULL AND key IS NOT NULL AND source IS NOT NULL AND (
           contains(source, 'Instagram') OR contains(source, 'Twitter for Android')
           OR contains(source, 'Twitter for iPhone') OR contains(source, 'Foursquare')
           OR contains(source, 'Tweetlogix') OR contains(source, 'Untappd'))) AS kept
  FROM f1_all GROUP BY file_seq),
raw_n AS (SELECT file_seq, count(*) AS raw_rows FROM posts_raw GROUP BY file_seq)""", """
SELECT CAST(r.file_seq AS BIGINT) AS file_seq, r.raw_rows, s.unique_rows, s.geo_tagged, s.in_area, s.kept
FROM raw_n r LEFT JOIN stages s USING (file_seq)""")

Q["joint_lag_rows"] = with_(SERIES + """,
si AS (SELECT series, row_number() OVER (ORDER BY f, series) - 1 AS idx
       FROM (SELECT series, min(bin) AS f FROM series GROUP BY series)),
v AS (SELECT s.bin, si.idx, s.value FROM series s JOIN si USING (series)),
nb AS (SELECT count(*) AS k FROM si),
b AS (SELECT bin, row_number() OVER (ORDER BY bin) - 1 AS pos FROM (SELECT DISTINCT bin FROM series))""", """
SELECT b.pos - 3 AS row_idx, b.bin, 'x' AS part, (vb.pos - (b.pos - 3)) * nb.k + v.idx AS pos, round(v.value, 6) AS value
FROM b JOIN b vb ON vb.pos BETWEEN b.pos - 3 AND b.pos - 1 JOIN v ON v.bin = vb.bin CROSS JOIN nb
WHERE b.pos >= 3
UNION ALL
SELECT b.pos - 3, b.bin, 'y', v.idx, round(v.value, 6) FROM b JOIN v ON v.bin = b.bin WHERE b.pos >= 3""")

# The joint form with mean-of-own-lags weights equals the per-series recursion.
Q["joint_recursive_mean"] = Q["recursive_mean_model"]
Q["joint_recursive_table"] = Q["recursive_mean_model"]

Q["posts_source_shares"] = with_(POSTS_CLEAN, """
SELECT source, "count", round("count" * 100.0 / sum("count") OVER (), 6) AS share
FROM (SELECT source, count(*) AS "count" FROM posts WHERE source IS NOT NULL GROUP BY source)""")

Q["posts_hourly_total"] = with_(POSTS_CLEAN + """,
pb AS (SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS bin, FID_nhood, id_str FROM posts
       WHERE created_at IS NOT NULL AND FID_nhood IS NOT NULL),
present AS (SELECT FID_nhood, bin, count(DISTINCT id_str) AS value FROM pb GROUP BY FID_nhood, bin),
grid AS """ + grid_sql("present", "FID_nhood", step="INTERVAL 1 HOUR"), """
SELECT grid.bin, CAST(sum(coalesce(value, 0)) AS BIGINT) AS total
FROM grid LEFT JOIN present USING (FID_nhood, bin) GROUP BY grid.bin""")

# ---- inputs with rows that must not go unseen ----------------------------------------------
_DIRTY = CALLS_RAW.replace("calls_raw AS (", "calls_good AS (") + """,
calls_raw AS (
  SELECT * REPLACE (
    CASE row_seq % 101 WHEN 7 THEN '01/02/2020 01:00' WHEN 8 THEN NULL ELSE call_timestamp END AS call_timestamp,
    CASE row_seq % 101 WHEN 9 THEN '300' WHEN 10 THEN 'high' WHEN 11 THEN NULL WHEN 15 THEN '2.5' ELSE priority END AS priority,
    CASE row_seq % 101 WHEN 12 THEN '83.1W' WHEN 16 THEN ' 1,083.5 ' ELSE longitude END AS longitude,
    CASE row_seq % 101 WHEN 13 THEN 'NaN' ELSE latitude END AS latitude,
    CASE row_seq % 101 WHEN 14 THEN 'A-17' ELSE incident_id END AS incident_id)
  FROM calls_good
)"""
_WHOLE = "regexp_full_match({c}, '[+-]?[0-9]+')"
_REFUSED = _DIRTY + f""",
ruled AS (
  SELECT file_seq, row_seq, trim(call_timestamp) AS ts, trim(priority) AS pri, replace(trim(incident_id), ',', '') AS iid,
         replace(trim(longitude), ',', '') AS lng, replace(trim(latitude), ',', '') AS lat
  FROM calls_raw WHERE neighborhood IS NOT NULL AND {_OKC} AND {_OKP}),
refused AS (
  SELECT file_seq, row_seq, 1 AS no, 'call_timestamp' AS col, 'not_a_timestamp' AS reason FROM ruled
    WHERE ts <> '' AND TRY_CAST(ts AS TIMESTAMP) IS NULL
  UNION ALL SELECT file_seq, row_seq, 2, 'incident_id', 'not_a_number' FROM ruled WHERE NOT {_WHOLE.format(c='iid')}
  UNION ALL SELECT file_seq, row_seq, 3, 'priority',
    CASE WHEN pri IS NULL THEN 'missing' WHEN {_WHOLE.format(c='pri')} THEN 'out_of_range'
         WHEN TRY_CAST(pri AS DOUBLE) IS NOT NULL THEN 'not_whole' ELSE 'not_a_number' END
    FROM ruled WHERE pri IS NULL OR NOT {_WHOLE.format(c='pri')} OR CAST(TRY_CAST(pri AS DOUBLE) AS DOUBLE) NOT BETWEEN -128 AND 127
  UNION ALL SELECT file_seq, row_seq, 4, 'longitude', 'not_a_number' FROM ruled WHERE TRY_CAST(lng AS DOUBLE) IS NULL
  UNION ALL SELECT file_seq, row_seq, 5, 'latitude', 'not_finite' FROM ruled WHERE isnan(TRY_CAST(lat AS DOUBLE)))"""
Q["call_rejects"] = with_(_REFUSED, """
SELECT CAST(file_seq AS BIGINT) AS file_seq, col AS "column", reason, count(*) AS "rows" FROM refused GROUP BY ALL""")

Q["rejected_calls"] = with_(_REFUSED, """
SELECT CAST(file_seq AS BIGINT) AS file_seq, row_seq, string_agg(col || ':' || reason, ',' ORDER BY no) AS rejects
FROM refused GROUP BY file_seq, row_seq""")

Q["dirty_clean_calls"] = with_(_DIRTY + CALLS_STAGED[len(CALLS_RAW):], """
SELECT incident_id, CAST(file_seq AS BIGINT) AS file_seq, call_timestamp,
       CASE WHEN row_seq % 101 <> 15 THEN CAST(priority AS BIGINT) END AS priority,
       longitude, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude
FROM calls_first""")

_PAGES_DIRTY = """pg AS (SELECT CAST(event_id // 500 + 1 AS BIGINT) AS page_no, count(*) AS n FROM events GROUP BY 1),
pc AS (SELECT page_no, CASE page_no % 7 WHEN 2 THEN 'error' WHEN 3 THEN 'corrupt' WHEN 4 THEN 'empty' WHEN 5 THEN 'no_features' ELSE 'ok' END AS page_class,
              CASE WHEN page_no % 7 = 2 THEN 400 + page_no % 2 * 100 END AS error_code,
              CASE WHEN page_no % 7 IN (0, 1, 6) THEN n ELSE 0 END AS "rows",
              page_no % 7 IN (0, 1, 6) AND page_no < max(page_no) OVER () AS more, page_no = max(page_no) OVER () AS is_last FROM pg)"""
Q["page_errors"] = with_(_PAGES_DIRTY, """
SELECT page_class, error_code, count(*) AS pages, CAST(sum("rows") AS BIGINT) AS "rows", min(page_no) AS first_page, max(page_no) AS last_page
FROM pc GROUP BY page_class, error_code""")

Q["page_audit_dirty"] = with_(_PAGES_DIRTY, """
SELECT page_no, page_class, "rows", more,
       CAST(coalesce(sum("rows") OVER (ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       page_class IN ('ok', 'empty') AND (CASE WHEN is_last THEN NOT more ELSE more END) AS consistent
FROM pc""")

Q["page_merge_dirty"] = "SELECT * FROM (" + Q["page_merge"] + ") WHERE page_no % 7 IN (0, 1, 6)"

Q["page_keys"] = with_(_PAGES_DIRTY, """
SELECT max(CASE WHEN more THEN true END) AS "exceededTransferLimit", max_by(error_code, page_no) FILTER (error_code IS NOT NULL) AS error_code,
       max(CASE WHEN page_class = 'error' THEN 'refused' END) AS error_message, max(CASE WHEN page_class = 'no_features' THEN 'ok' END) AS status
FROM pc""")

Q["page_order"] = """
SELECT CAST(s_suppkey // 10 + 1 AS BIGINT) AS page_no, count(*) AS "rows", CAST(min(s_suppkey) AS BIGINT) AS min_id,
       CAST(max(s_suppkey) AS BIGINT) AS max_id, true AS ascending, true AS follows
FROM supplier GROUP BY 1"""

Q["geometry_audit"] = """
SELECT CASE s_suppkey % 13 WHEN 1 THEN 'not_a_polygon' WHEN 2 THEN 'bad_coordinates' WHEN 3 THEN 'too_few_points' WHEN 4 THEN 'bad_coordinates'
            WHEN 5 THEN 'bad_coordinates' WHEN 6 THEN 'closed_here' ELSE 'ok' END AS reason, count(*) AS "rows"
FROM supplier GROUP BY 1"""

Q["landed_posts_clean"] = with_(POLY + ",\n" + STATUS_BASE + f""",
lp AS (SELECT event_id, ts, lng, lat, CASE WHEN event_id % 13 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS "user" FROM sd WHERE {_IN_BOX}),
""" + pip_sql("lp", "event_id", "lng", "lat"), """
SELECT date_trunc('second', ts) AS created_at, CAST(event_id AS VARCHAR) AS id_str, "user", round(lng, 6) AS lng, round(lat, 6) AS lat, pip.key AS FID_nhood
FROM lp JOIN pip ON pip.pid = event_id""")

# ---- city-block polygons (from supplier; grows with the scale factor) --------------------
import re as _re  # noqa: E402

BLOCKS = """bl AS (SELECT s_suppkey AS nhood_num, 'BLOCK_' || CAST(s_nationkey AS VARCHAR) AS nhood_name FROM supplier),
bpoly AS (
  SELECT nhood_num AS file_pos, nhood_num, nhood_name, CAST(nhood_num AS VARCHAR) || ',' || nhood_name AS key,
         CAST(nhood_num % 20 AS DOUBLE) AS x0, CAST(nhood_num // 20 AS DOUBLE) AS y0
  FROM bl
),
bedges AS (
  SELECT file_pos, key, x0 AS x1, y0 AS y1, x0 + 1 AS x2, y0 AS y2 FROM bpoly UNION ALL
  SELECT file_pos, key, x0 + 1, y0, x0 + 1, y0 + 1 FROM bpoly UNION ALL
  SELECT file_pos, key, x0 + 1, y0 + 1, x0 + 0.5, y0 + 1 FROM bpoly UNION ALL
  SELECT file_pos, key, x0 + 0.5, y0 + 1, x0, y0 + 0.5 FROM bpoly UNION ALL
  SELECT file_pos, key, x0, y0 + 0.5, x0, y0 FROM bpoly
)"""

_ADJ_BODY = ADJ[len(POLY) + 2:]
ADJ_BLOCKS = BLOCKS + ",\n" + _re.sub(r"\bpoly\b", "bpoly", _re.sub(r"\bedges\b", "bedges", _ADJ_BODY))

Q["adjacency"] = with_(ADJ_BLOCKS, "SELECT centre, neighbour FROM adj")

Q["polygon_scan"] = with_(BLOCKS, """
SELECT key, CAST(nhood_num AS BIGINT) AS nhood_num, nhood_name, CAST(6 AS BIGINT) AS n_points,
       x0 AS minx, y0 AS miny, x0 + 1 AS maxx, y0 + 1 AS maxy, true AS valid FROM bpoly""")

Q["nhood_num_list"] = with_(BLOCKS, """
SELECT nhood_name, string_agg(CAST(nhood_num AS VARCHAR), ',' ORDER BY nhood_num) AS nums,
       CAST(min(nhood_num) AS BIGINT) AS first_num
FROM bl GROUP BY nhood_name""")

Q["geojson_flatten"] = with_(BLOCKS, """
SELECT CAST(nhood_num // 10 + 1 AS BIGINT) AS page_no,
       row_number() OVER (PARTITION BY nhood_num // 10 ORDER BY nhood_num) - 1 AS feature_pos,
       CAST(nhood_num AS BIGINT) AS FID, nhood_name, 'Polygon' AS geometry_type, key, CAST(6 AS BIGINT) AS n_points,
       x0 AS minx, y0 AS miny, x0 + 1 AS maxx, y0 + 1 AS maxy
FROM bpoly""")

Q["geojson_sink_roundtrip"] = with_(BLOCKS, """
SELECT CAST(nhood_num AS BIGINT) AS FID, nhood_name, 'Polygon' AS geometry_type FROM bl""")

# ---- seasonal-AR grid (p in 1..3, d in 0..1, season 8, 8 steps) ---------------------------
def _ar_sql(hist_where: str, target_split: str, best_only: bool) -> str:
    """CTEs ending in ``ar_loss(series, p, d, loss)``: difference the history,
    Yule-Walker AR(p) via Durbin-Levinson (orders 1-3 written out), forecast 8
    steps recursively, undo the differences, MSE against the first 8 rows of
    ``target_split``."""
    best = ""
    if best_only:
        best = "JOIN best_pd b ON b.series = c.series AND b.p = c.p AND b.d = c.d"
    return f"""tr AS (SELECT s.series, s.bin, s.value AS x FROM series s JOIN lab USING (bin) WHERE {hist_where}),
dd AS (SELECT * FROM (VALUES (0), (1)) v(d)),
zt AS (
  SELECT series, bin, d, x, x - lag(x, 8) OVER w AS y,
         CASE WHEN d = 0 THEN x - lag(x, 8) OVER w
              ELSE (x - lag(x, 8) OVER w) - (lag(x, 1) OVER w - lag(x, 9) OVER w) END AS z
  FROM tr CROSS JOIN dd WINDOW w AS (PARTITION BY series, d ORDER BY bin)),
zc AS (SELECT *, z - avg(z) OVER (PARTITION BY series, d) AS zc, avg(z) OVER (PARTITION BY series, d) AS mu FROM zt),
zl AS (SELECT *, lag(CASE WHEN z IS NOT NULL THEN zc END, 1) OVER w2 AS l1,
              lag(CASE WHEN z IS NOT NULL THEN zc END, 2) OVER w2 AS l2,
              lag(CASE WHEN z IS NOT NULL THEN zc END, 3) OVER w2 AS l3
       FROM zc WINDOW w2 AS (PARTITION BY series, d ORDER BY bin)),
sk AS (SELECT series, d, first(mu) AS mu,
              sum(CASE WHEN z IS NOT NULL THEN zc * zc END) AS s0, sum(CASE WHEN z IS NOT NULL THEN zc * l1 END) AS s1,
              sum(CASE WHEN z IS NOT NULL THEN zc * l2 END) AS s2, sum(CASE WHEN z IS NOT NULL THEN zc * l3 END) AS s3
       FROM zl GROUP BY series, d),
rh AS (SELECT series, d, mu, s1 / NULLIF(s0, 0) AS r1, s2 / NULLIF(s0, 0) AS r2, s3 / NULLIF(s0, 0) AS r3 FROM sk),
dl1 AS (SELECT *, (r1 - 0.0) / NULLIF(1.0 - 0.0, 0) AS f11 FROM rh),
dl2 AS (SELECT *, (r2 - (0.0 + f11 * r1)) / NULLIF(1.0 - (0.0 + f11 * r1), 0) AS f22 FROM dl1),
dl3 AS (SELECT *, f11 - f22 * f11 AS f21 FROM dl2),
dl4 AS (SELECT *, (r3 - ((0.0 + f21 * r2) + f22 * r1)) / NULLIF(1.0 - ((0.0 + f21 * r1) + f22 * r2), 0) AS f33 FROM dl3),
dl AS (SELECT *, f21 - f33 * f22 AS f31, f22 - f33 * f21 AS f32 FROM dl4),
tl AS (SELECT series, d, x, y, z, row_number() OVER (PARTITION BY series, d ORDER BY bin DESC) AS back FROM zt),
init AS (SELECT series, d, max(z) FILTER (WHERE back = 1) AS z1, max(z) FILTER (WHERE back = 2) AS z2,
                max(z) FILTER (WHERE back = 3) AS z3, max(y) FILTER (WHERE back = 1) AS yl
         FROM tl GROUP BY series, d),
xh AS (SELECT series, d, back, x FROM tl WHERE back <= 8),
cand AS (
  SELECT c.series, c.d, c.p, c.mu, c.a1, c.a2, c.a3 FROM (
    SELECT series, d, pp.p, mu,
           CASE pp.p WHEN 1 THEN f11 WHEN 2 THEN f21 ELSE f31 END AS a1,
           CASE pp.p WHEN 2 THEN f22 WHEN 3 THEN f32 END AS a2,
           CASE pp.p WHEN 3 THEN f33 END AS a3
    FROM dl CROSS JOIN (VALUES (1), (2), (3)) pp(p)) c {best}),
rec AS (
  WITH RECURSIVE r(series, d, p, step, mu, a1, a2, a3, z1, z2, z3, yl) AS (
    SELECT c.series, c.d, c.p, 0, c.mu, c.a1, c.a2, c.a3, i.z1, i.z2, i.z3, i.yl
    FROM cand c JOIN init i ON i.series = c.series AND i.d = c.d
    UNION ALL
    SELECT series, d, p, step + 1, mu, a1, a2, a3, zp, z1, z2, CASE WHEN d = 1 THEN yl + zp ELSE zp END
    FROM (SELECT *, mu + CASE p WHEN 1 THEN (0.0 + a1 * (z1 - mu))
                                WHEN 2 THEN ((0.0 + a1 * (z1 - mu)) + a2 * (z2 - mu))
                                ELSE (((0.0 + a1 * (z1 - mu)) + a2 * (z2 - mu)) + a3 * (z3 - mu)) END AS zp
          FROM r WHERE step < 8) q
  )
  SELECT series, d, p, step, yl AS yp FROM r WHERE step >= 1
),
pred AS (SELECT rec.series, rec.p, rec.d, rec.step, rec.yp + xh.x AS pred
         FROM rec JOIN xh ON xh.series = rec.series AND xh.d = rec.d AND xh.back = 9 - rec.step),
act AS (SELECT series, step, actual FROM (
          SELECT s.series, row_number() OVER (PARTITION BY s.series ORDER BY s.bin) AS step, s.value AS actual
          FROM series s JOIN lab USING (bin) WHERE split = '{target_split}') WHERE step <= 8),
ar_loss AS (SELECT pred.series, pred.p, pred.d, avg(pow(act.actual - pred.pred, 2)) AS loss
            FROM pred JOIN act ON act.series = pred.series AND act.step = pred.step
            GROUP BY pred.series, pred.p, pred.d)"""


AR_GRID = SERIES + ",\nlab AS " + _split_sql("bin", "series") + ",\n" + _ar_sql("split = 'train'", "validation", False)

Q["ar_grid"] = with_(AR_GRID, """
SELECT series, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, round(loss, 6) AS loss,
       CAST((p - 1) * 2 + d AS BIGINT) AS cand_idx FROM ar_loss""")

_BEST = """SELECT series, p, d, loss, (p - 1) * 2 + d AS cand_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY loss, (p - 1) * 2 + d) AS rn
  FROM ar_loss WHERE loss IS NOT NULL AND NOT isnan(loss)) WHERE rn = 1"""

Q["best_of_grid"] = with_(AR_GRID, f"""
SELECT series, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, round(loss, 6) AS loss, CAST(cand_idx AS BIGINT) AS cand_idx
FROM ({_BEST})""")

_HOLD = _ar_sql("split <> 'test'", "test", True).replace("tr AS (", "tr AS (", 1)
_HOLD_NAMES = ["tr", "dd", "zt", "zc", "zl", "sk", "rh", "dl1", "dl2", "dl3", "dl4", "dl", "tl", "init", "xh",
               "cand", "rec", "pred", "act", "ar_loss"]
for _n in _HOLD_NAMES:
    _HOLD = _re.sub(rf"\b{_n}\b", f"h_{_n}", _HOLD)
Q["ar_holdout"] = with_(AR_GRID + ",\nbest_pd AS (" + _BEST + "),\n" + _HOLD, """
SELECT series, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, round(loss, 6) AS loss FROM h_ar_loss""")

# ---- the grid at p = 0, 1 and d = 0, 1, 2 -----------------------------------------------------
Q["ar_grid_wide"] = with_(SERIES + ",\nlab AS " + _split_sql("bin", "series") + """,
yt AS (SELECT s.series, s.bin, s.value AS x, s.value - lag(s.value, 8) OVER (PARTITION BY s.series ORDER BY s.bin) AS y
       FROM series s JOIN lab USING (bin) WHERE split = 'train'),
zt AS (SELECT series, bin, d, x, y, y - lag(y, 1) OVER w AS dy,
              CASE d WHEN 0 THEN y WHEN 1 THEN y - lag(y, 1) OVER w ELSE y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w END AS z
       FROM yt CROSS JOIN (VALUES (0), (1), (2)) v(d) WINDOW w AS (PARTITION BY series, d ORDER BY bin)),
zc AS (SELECT *, z - avg(z) OVER (PARTITION BY series, d) AS zc, avg(z) OVER (PARTITION BY series, d) AS mu FROM zt),
zl AS (SELECT *, lag(zc, 1) OVER (PARTITION BY series, d ORDER BY bin) AS l1 FROM zc),
sk AS (SELECT series, d, first(mu) AS mu, sum(zc * l1) / NULLIF(sum(zc * zc), 0) AS a1 FROM zl GROUP BY series, d),
tl AS (SELECT *, row_number() OVER (PARTITION BY series, d ORDER BY bin DESC) AS back FROM zt),
init AS (SELECT series, d, z AS z1, y AS yl, dy AS dl FROM tl WHERE back = 1),
rec AS (
  WITH RECURSIVE r(series, d, p, step, mu, a1, z1, yl, dl) AS (
    SELECT series, d, p, 0, mu, a1, z1, yl, dl FROM sk JOIN init USING (series, d) CROSS JOIN (VALUES (0), (1)) v(p)
    UNION ALL
    SELECT series, d, p, step + 1, mu, a1, zp, CASE d WHEN 0 THEN zp WHEN 1 THEN yl + zp ELSE yl + (dl + zp) END, dl + zp
    FROM (SELECT *, mu + CASE p WHEN 1 THEN a1 * (z1 - mu) ELSE 0 END AS zp FROM r WHERE step < 8) q)
  SELECT series, d, p, step, yl AS yp FROM r WHERE step >= 1),
pred AS (SELECT rec.*, yp + tl.x AS pred FROM rec JOIN tl ON tl.series = rec.series AND tl.d = rec.d AND tl.back = 9 - rec.step),
act AS (SELECT s.series, row_number() OVER (PARTITION BY s.series ORDER BY s.bin) AS step, s.value AS actual
        FROM series s JOIN lab USING (bin) WHERE split = 'validation')""", """
SELECT pred.series, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, round(avg(pow(actual - pred, 2)), 6) AS loss, CAST(p * 3 + d AS BIGINT) AS cand_idx
FROM pred JOIN act ON act.series = pred.series AND act.step = pred.step GROUP BY pred.series, p, d""")
