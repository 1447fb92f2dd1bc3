"""Polygons, point labelling, adjacency and radius matching.

Point-in-polygon plan: polygons live in a grid of several levels, a level's
cell side a power of two; each polygon is registered at the level of its own
size, so a city outline beside ten thousand blocks does not widen the blocks'
cells.  A cell carries the array of candidate polygons (position, key, edges).
Points probe each level in use (few, ``MAX_LEVELS`` at most) by an equi-join on
their cell there; the exact closed-region test is a fold over edges, and the
first polygon in file order among the hits of all levels wins.  A level's
candidate table is broadcast when it is small (checked) and the point side is
then never shuffled; otherwise that level is a shuffle join on the cell key,
where AQE skew handling splits hot cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import (bbox, clearly_inside, covers_point, haversine_km, interior_point, orient,
                                  piece_midpoints, ring_edges, ring_from_coords)
from ..functions.text import geo_param_text, key_compose, parse_radius_km
from ..session import DEFAULT_BROADCAST_LIMIT, cut_lineage


GEOMETRY_REASONS = ("not_a_polygon", "bad_coordinates", "too_few_points")


def _parsed(df: DataFrame, coords_col: str, type_col: str | None) -> tuple[Column, Column]:
    """(outer ring as array of [x, y], geometry type)."""
    coords = F.col(f"`{coords_col}`")
    parsed = F.from_json(coords, "array<array<array<double>>>") if dict(df.dtypes)[coords_col] == "string" else coords
    return F.get(parsed, 0), F.col(f"`{type_col}`") if type_col else F.lit("Polygon")


def geometry_reason(outer: Column, kind: Column) -> Column:
    """Why a geometry gives no polygon (one of ``GEOMETRY_REASONS``), or NULL.
    A point must be two finite numbers, a ring have three distinct points; a
    ring that does not end where it began is closed and not refused."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    good = F.forall(outer, lambda p: F.coalesce((F.size(p) >= 2) & finite(F.get(p, 0)) & finite(F.get(p, 1)), F.lit(False)))
    return (F.when(kind.isNull() | (kind != "Polygon"), F.lit("not_a_polygon"))
            .when(outer.isNull() | ~F.coalesce(good, F.lit(False)), F.lit("bad_coordinates"))
            .when(F.size(F.array_distinct(F.transform(outer, lambda p: F.slice(p, 1, 2)))) < 3, F.lit("too_few_points")))


def geometry_audit(df: DataFrame, coords_col: str = "geometry.coordinates", type_col: str | None = None) -> DataFrame:
    """``(reason, rows)``: the polygon table's rows by what became of their
    geometry - a reason, ``closed_here`` (taken, but its ring was open) or ``ok`` (S7, F12)."""
    outer, kind = _parsed(df, coords_col, type_col)
    rows = df.select(outer.alias("_outer"), kind.alias("_type"))
    reason = geometry_reason(F.col("_outer"), F.col("_type"))
    ends = lambda at: F.slice(F.element_at("_outer", at), 1, 2)
    became = F.coalesce(reason, F.when(ends(1) != ends(-1), F.lit("closed_here")).otherwise(F.lit("ok")))
    return rows.select(became.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


# ---- S7 ----------------------------------------------------------------------------
def polygons_from_table(df: DataFrame, num_col: str = "nhood_num", name_col: str = "nhood_name",
                        coords_col: str = "geometry.coordinates", pos_col: str | None = None,
                        type_col: str | None = None) -> DataFrame:
    """Neighbourhood table -> polygons ``(file_pos, key, nhood_num, nhood_name, ring, edges,
    minx, miny, maxx, maxy, valid, reason)``.

    ``coords_col`` holds the GeoJSON coordinates (text or array); only the
    outer ring (element 0) is used.  Duplicate keys: the later row's polygon
    wins, the first row's position stays.  A geometry with a ``reason``
    (:func:`geometry_reason`) gets ``valid = false`` and never matches;
    :func:`geometry_audit` counts them.
    """
    pos = F.col(pos_col) if pos_col else F.monotonically_increasing_id()
    outer, kind = _parsed(df, coords_col, type_col)
    rows = df.select(
        pos.cast("long").alias("_pos"),
        F.col(f"`{num_col}`").alias("nhood_num"), F.col(f"`{name_col}`").alias("nhood_name"),
        kind.alias("_type"), outer.alias("_outer"))
    rows = rows.withColumn("key", key_compose("nhood_num", "nhood_name")).withColumn("reason", geometry_reason(F.col("_outer"), F.col("_type")))
    rows = rows.withColumn("ring", F.when(F.col("reason").isNull(), ring_from_coords(F.col("_outer"))))
    g = rows.groupBy("key").agg(
        F.min("_pos").alias("file_pos"),
        F.max_by(F.struct("nhood_num", "nhood_name", "ring", "reason"), "_pos").alias("_last"))
    out = g.select("file_pos", "key", "_last.nhood_num", "_last.nhood_name", "_last.ring", "_last.reason")
    mnx, mny, mxx, mxy = bbox(F.col("ring"))
    return out.select("file_pos", "key", "nhood_num", "nhood_name", "ring",
                      ring_edges(F.col("ring")).alias("edges"),
                      mnx.alias("minx"), mny.alias("miny"), mxx.alias("maxx"), mxy.alias("maxy"),
                      F.col("ring").isNotNull().alias("valid"), "reason")


def polygons_from_rings(df: DataFrame, pos_col: str, num_col: str, name_col: str,
                        ring_col: str) -> DataFrame:
    """Same output as :func:`polygons_from_table` from an existing ring column."""
    r = F.col(ring_col)
    mnx, mny, mxx, mxy = bbox(r)
    return df.select(F.col(pos_col).cast("long").alias("file_pos"),
                     key_compose(num_col, name_col).alias("key"),
                     F.col(num_col).alias("nhood_num"), F.col(name_col).alias("nhood_name"),
                     r.alias("ring"), ring_edges(r).alias("edges"),
                     mnx.alias("minx"), mny.alias("miny"), mxx.alias("maxx"), mxy.alias("maxy"),
                     r.isNotNull().alias("valid"))


# ---- grid cells --------------------------------------------------------------------
MAX_LEVELS = 8            # grid levels that are probed at most
MAX_CUTS = 64             # a polygon with many edges is cut into this many cells a side at most
EDGES_PER_CUT = 16


def _level(side: Column) -> Column:
    """Exponent of the smallest power of two that is no less than ``side`` (NULL for 0)."""
    return F.ceil(F.log2(F.when(side > 0, side))).cast("int")


def polygon_level(minx="minx", miny="miny", maxx="maxx", maxy="maxy", edges="edges") -> Column:
    """Grid level of a polygon: cells as wide as its box, or finer the more edges
    it has (a cell's candidates carry only the edges of its band)."""
    cuts = F.least(F.lit(float(MAX_CUTS)), F.greatest(F.lit(1.0), F.sqrt(F.size(edges) / EDGES_PER_CUT)))
    return _level(F.greatest(F.col(maxx) - F.col(minx), F.col(maxy) - F.col(miny)) / cuts)


def merge_levels(found: Sequence[int], most: int = MAX_LEVELS) -> dict[int, int]:
    """Level -> level in use.  Beyond ``most`` levels neighbours share the coarser one."""
    found = sorted(set(found))
    per = -(-len(found) // most) if found else 1
    return {lv: found[min(len(found), (i // per + 1) * per) - 1] for i, lv in enumerate(found)}


def polygon_stats(polys: DataFrame) -> dict:
    """One small aggregate over the polygon table (a row per size class): count,
    the grid levels in use, and for each an upper bound of its candidate table's
    bytes (a polygon covers at most (w/c + 2)(h/c + 2) cells of side c)."""
    v = polys.where("valid").withColumn("_lv", polygon_level())
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    e = F.size("edges") * 32 + 96
    rows = v.groupBy("_lv").agg(F.count(F.lit(1)).alias("n"), F.sum(e * w * h).alias("ewh"),
                                F.sum(e * (w + h)).alias("ew"), F.sum(e).alias("e")).collect()
    levels = merge_levels([r["_lv"] for r in rows if r["_lv"] is not None])
    finest = min(levels.values(), default=0)
    level_bytes: dict[int, int] = {}
    for r in rows:
        lv = levels.get(r["_lv"], finest)   # polygons without extent go to the finest level
        c = 2.0 ** lv
        level_bytes[lv] = level_bytes.get(lv, 0) + int(r["ewh"] / c ** 2 + 2 * r["ew"] / c + 4 * r["e"])
    return {"n": sum(r["n"] for r in rows), "levels": levels, "level_bytes": level_bytes,
            "est_bytes": sum(level_bytes.values())}


def _level_in_use(level: Column, levels: dict[int, int]) -> Column:
    """The level in use for a level found (``levels`` of :func:`polygon_stats`)."""
    if not levels:
        return F.lit(0)
    known = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, level), F.lit(min(levels.values())))


def _cells(df: DataFrame, cell: float | Column, minx="minx", miny="miny", maxx="maxx", maxy="maxy") -> DataFrame:
    cs = cell if isinstance(cell, Column) else F.lit(float(cell))
    return (df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col(minx) / cs),
                                                      F.floor(F.col(maxx) / cs))))
              .withColumn("_cy", F.explode(F.sequence(F.floor(F.col(miny) / cs),
                                                      F.floor(F.col(maxy) / cs)))))


def _cell_of(x, level: int) -> Column:
    """Cell number at a level; dividing by a power of two is exact."""
    return F.floor(F.col(x) / F.lit(2.0 ** level))


def candidate_cells(polys: DataFrame, level: int) -> DataFrame:
    """(cell -> candidate polygons) table of one grid level.  Each candidate
    carries only the edges whose y-range meets the cell's horizontal band: a
    point's ray crossings and on-edge test only involve edges spanning its y,
    and cell numbers are exact, so this is exact and keeps both the table and
    the per-point fold small."""
    side = F.lit(2.0 ** level)
    cells = _cells(polys.where("valid"), 2.0 ** level)
    lo, hi = F.col("_cy") * side, (F.col("_cy") + 1) * side
    band = F.filter("edges", lambda e: (F.least(e.y1, e.y2) <= hi) & (F.greatest(e.y1, e.y2) >= lo))
    return cells.groupBy("_cx", "_cy").agg(
        F.collect_list(F.struct("file_pos", "key", "minx", "miny", "maxx", "maxy", band.alias("edges")))
        .alias("_cands"))


# ---- J1 ----------------------------------------------------------------------------
def label_points(points: DataFrame, polys: DataFrame, lng_col: str, lat_col: str,
                 out_col: str = "FID_nhood", only_when: Column | None = None,
                 broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, stats: dict | None = None) -> DataFrame:
    """Key of the first polygon (file order) that contains the point or has it on
    its boundary; NULL when none or when coordinates are NULL (J1).  One lookup
    per grid level in use."""
    stats = stats or polygon_stats(polys)
    px, py = F.col(lng_col), F.col(lat_col)
    placed = polys.where("valid").withColumn("_lv", _level_in_use(polygon_level(), stats["levels"]))
    joined, hits, room = points, [], broadcast_limit
    for lv, size in sorted(stats["level_bytes"].items(), reverse=True):
        cand = candidate_cells(placed.where(F.col("_lv") == lv), lv).withColumnRenamed("_cands", f"_cands{lv}")
        if size <= room:  # all broadcasts together stay under the limit
            cand, room = F.broadcast(cand), room - size
        cx, cy = _cell_of(lng_col, lv), _cell_of(lat_col, lv)
        if only_when is not None:
            cx, cy = F.when(only_when, cx), F.when(only_when, cy)
        joined = joined.withColumns({"_cx": cx, "_cy": cy}).join(cand, ["_cx", "_cy"], "left").drop("_cx", "_cy")
        # cheap bounding-box test first; the exact edge fold runs only on survivors
        in_box = F.filter(F.col(f"_cands{lv}"), lambda c: (px >= c.minx) & (px <= c.maxx) & (py >= c.miny) & (py <= c.maxy))
        inside = F.filter(in_box, lambda c: covers_point(c.edges, px, py))
        hits.append(F.array_min(F.transform(inside, lambda c: F.struct(c.file_pos.alias("p"), c.key.alias("k")))))
    if not hits:
        return points.withColumn(out_col, F.lit(None).cast("string"))
    best = F.array_min(F.array_compact(F.array(*hits)))
    # one value a row, by a generator: a filter on a plain column would run the whole test a second time
    return joined.withColumn(out_col, F.explode(F.array(best.getField("k")))).drop(*[f"_cands{lv}" for lv in stats["level_bytes"]])


# ---- J3 ----------------------------------------------------------------------------
def nhood_nums(polys: DataFrame) -> DataFrame:
    """Name -> list of nums in file order, and the first num."""
    g = polys.groupBy("nhood_name").agg(
        F.array_sort(F.collect_list(F.struct("file_pos", "nhood_num"))).alias("_l"))
    return g.select("nhood_name",
                    F.transform("_l", lambda s: s.nhood_num).alias("nums"),
                    F.element_at("_l", 1).nhood_num.alias("first_num"))


# ---- J2 ----------------------------------------------------------------------------
def relabel(df: DataFrame, polys: DataFrame, names: Sequence[str], name_col: str = "neighborhood",
            lng_col: str = "longitude", lat_col: str = "latitude", out_col: str = "FID_nhood",
            on_unknown: str = "error") -> DataFrame:
    """Rows whose name is in ``names`` are located by point-in-polygon; the rest
    get ``"<first num of name>,<name>"`` (J2).  One pass: the polygon lookup
    only runs for the listed rows (others get no cell key).

    ``on_unknown``: ``'error'`` raises on a name with no polygon, ``'null'``
    yields NULL (dropped later).
    """
    names = list(names)
    listed = F.col(name_col).isin(names) if names else F.lit(False)
    stats = polygon_stats(polys)
    located = label_points(df, polys, lng_col, lat_col, out_col="_pip", only_when=listed, stats=stats)
    lookup = nhood_nums(polys).select(F.col("nhood_name").alias("_nm"), F.col("first_num").alias("_fn"))
    lookup = F.broadcast(lookup) if stats["n"] * 256 <= DEFAULT_BROADCAST_LIMIT else lookup
    j = located.join(lookup, F.col(name_col) == F.col("_nm"), "left")
    other = F.when(F.col("_fn").isNotNull(),
                   F.concat_ws(",", F.col("_fn").cast("string"), F.col(name_col)))
    if on_unknown == "error":
        unknown = F.col("_fn").isNull() & F.col(name_col).isNotNull()
        msg = F.concat(F.lit("unknown neighbourhood name: "), F.col(name_col))
        other = F.when(unknown, F.raise_error(msg).cast("string")).otherwise(other)
    return (j.withColumn(out_col, F.when(listed, F.col("_pip")).otherwise(other))
             .drop("_pip", "_nm", "_fn"))


# ---- J4 ----------------------------------------------------------------------------
def _seg_intersect(a: Column, b: Column) -> Column:
    o1 = orient(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1)
    o2 = orient(a.x1, a.y1, a.x2, a.y2, b.x2, b.y2)
    o3 = orient(b.x1, b.y1, b.x2, b.y2, a.x1, a.y1)
    o4 = orient(b.x1, b.y1, b.x2, b.y2, a.x2, a.y2)

    def on(px, py, s):
        return ((px >= F.least(s.x1, s.x2)) & (px <= F.greatest(s.x1, s.x2))
                & (py >= F.least(s.y1, s.y2)) & (py <= F.greatest(s.y1, s.y2)))
    general = (o1 != o2) & (o3 != o4)
    return (general
            | ((o1 == 0) & on(b.x1, b.y1, a)) | ((o2 == 0) & on(b.x2, b.y2, a))
            | ((o3 == 0) & on(a.x1, a.y1, b)) | ((o4 == 0) & on(a.x2, a.y2, b)))


def _proper_cross(a: Column, b: Column) -> Column:
    o1 = orient(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1)
    o2 = orient(a.x1, a.y1, a.x2, a.y2, b.x2, b.y2)
    o3 = orient(b.x1, b.y1, b.x2, b.y2, a.x1, a.y1)
    o4 = orient(b.x1, b.y1, b.x2, b.y2, a.x2, a.y2)
    return (o1 * o2 < 0) & (o3 * o4 < 0)


INSIDE_TOL = 1e-9   # degrees: closer to a boundary than this counts as on it


def _enters(near_own: Column, near_other: Column, other: Column, in_box) -> Column:
    """Some piece of the own edges runs inside the other ring: edges are split at
    all their contacts with the other ring, so no piece changes sides."""
    def pieces(e):
        facing = F.filter(near_other, lambda f: (F.least(f.x1, f.x2) <= F.greatest(e.x1, e.x2)) & (F.greatest(f.x1, f.x2) >= F.least(e.x1, e.x2))
                          & (F.least(f.y1, f.y2) <= F.greatest(e.y1, e.y2)) & (F.greatest(f.y1, f.y2) >= F.least(e.y1, e.y2)))
        return F.filter(piece_midpoints(e, facing), in_box)
    return F.exists(F.flatten(F.transform(near_own, pieces)), lambda q: clearly_inside(other, q.x, q.y, INSIDE_TOL))


def box_pairs(p: DataFrame, stats: dict) -> DataFrame:
    """``(pa, pb)``: every unordered pair of polygons whose boxes meet, once.
    Polygons are at home in the cells of their own level and probe those of
    their own and all coarser levels in use; a pair counts in the cell of the
    lower corner of its overlap."""
    levels = sorted(set(stats["levels"].values())) or [0]
    box = ["file_pos", "minx", "miny", "maxx", "maxy"]
    at = p.select(*box, _level_in_use(polygon_level(), stats["levels"]).alias("_lv"))
    side = F.pow(F.lit(2.0), F.col("_at"))
    home = _cells(at.withColumn("_at", F.col("_lv")), side)
    coarser = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("_lv"))
    probe = _cells(at.withColumn("_at", F.explode(coarser)), side)
    corner = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / F.pow(F.lit(2.0), F.col("_at")))
    # a finer polygon meets a coarser one; two of one level in file order
    ahead = (F.col("a._lv") < F.col("b._lv")) | ((F.col("a._lv") == F.col("b._lv")) & (F.col("a.file_pos") < F.col("b.file_pos")))
    return (probe.alias("a").join(home.alias("b"), ["_at", "_cx", "_cy"])
            .where(ahead & (F.col("a.minx") <= F.col("b.maxx")) & (F.col("b.minx") <= F.col("a.maxx"))
                   & (F.col("a.miny") <= F.col("b.maxy")) & (F.col("b.miny") <= F.col("a.maxy"))
                   & (F.col("_cx") == corner("minx")) & (F.col("_cy") == corner("miny")))
            .select(F.col("a.file_pos").alias("pa"), F.col("b.file_pos").alias("pb")))


def adjacency(polys: DataFrame) -> DataFrame:
    """All (centre, neighbour) pairs of polygons that *touch*: boundaries meet,
    interiors disjoint (corner contact counts; self, overlap, containment and
    equal rings do not) (J4).

    Candidates are :func:`box_pairs`.  The tests run in stages, each on the
    pairs the last one left: the boundaries must meet; where the overlap of the
    boxes has no area that settles it (neighbours side by side); only the rest
    is tested for crossing edges and for pieces of one inside the other.  Both
    directions of a pair are emitted.
    """
    p = polys.where("valid").select("file_pos", "key", "edges", "minx", "miny", "maxx", "maxy",
                                    interior_point(F.col("edges")).alias("inner"))
    a = p.select(*[F.col(c).alias(c + "_a") for c in p.columns])
    b = p.select(*[F.col(c).alias(c + "_b") for c in p.columns])
    j = box_pairs(p, polygon_stats(polys)).join(a, F.col("pa") == F.col("file_pos_a")).join(b, F.col("pb") == F.col("file_pos_b"))
    # Exact pruning before the nested tests: two edges can only meet inside the
    # overlap of the two boxes, and a point strictly inside a polygon lies in
    # the open interior of its box - so typical neighbours test only the edges
    # of a thin strip.
    ix0, ix1 = F.greatest("minx_a", "minx_b"), F.least("maxx_a", "maxx_b")
    iy0, iy1 = F.greatest("miny_a", "miny_b"), F.least("maxy_a", "maxy_b")

    def near(e):
        return ((F.least(e.x1, e.x2) <= ix1) & (F.greatest(e.x1, e.x2) >= ix0)
                & (F.least(e.y1, e.y2) <= iy1) & (F.greatest(e.y1, e.y2) >= iy0))

    def in_box(q, side):  # open box: a strictly interior point is never on its edge
        return ((q.x > F.col(f"minx_{side}")) & (q.x < F.col(f"maxx_{side}"))
                & (q.y > F.col(f"miny_{side}")) & (q.y < F.col(f"maxy_{side}")))
    # a generator ends a stage: the optimiser does not work its columns out again for each test
    strip = F.struct(F.filter("edges_a", near).alias("na"), F.filter("edges_b", near).alias("nb"),
                     ((ix1 <= ix0) | (iy1 <= iy0)).alias("flat"))
    j = j.withColumn("s", F.explode(F.array(strip)))
    na, nb, ea, eb = F.col("s.na"), F.col("s.nb"), F.col("edges_a"), F.col("edges_b")
    meet = F.exists(na, lambda x: F.exists(nb, lambda y: _seg_intersect(x, y)))
    cross = F.exists(na, lambda x: F.exists(nb, lambda y: _proper_cross(x, y)))
    a_in_b = _enters(na, nb, eb, lambda q: in_box(q, "b"))
    b_in_a = _enters(nb, na, ea, lambda q: in_box(q, "a"))
    # rings that bound the same region in other vertices: one interior point tells
    same = F.coalesce(clearly_inside(eb, F.col("inner_a.x"), F.col("inner_a.y"), INSIDE_TOL), F.lit(False))
    touch = meet & (F.col("s.flat") | (~cross & ~same & ~a_in_b & ~b_in_a))
    both = F.array(
        F.struct(F.col("key_a").alias("centre"), F.col("key_b").alias("neighbour"),
                 F.col("file_pos_a").alias("centre_pos"), F.col("file_pos_b").alias("neighbour_pos")),
        F.struct(F.col("key_b").alias("centre"), F.col("key_a").alias("neighbour"),
                 F.col("file_pos_b").alias("centre_pos"), F.col("file_pos_a").alias("neighbour_pos")))
    return j.where(touch).select(F.inline(both))


# ---- J8 / F12 ----------------------------------------------------------------------
def name_reconcile(polys: DataFrame, records: DataFrame, name_col: str = "neighborhood") -> DataFrame:
    """Names only in boundaries, only in records, and names shared by several
    polygons (J8) as one table ``(name, issue, n)``."""
    pn = polys.select(F.col("nhood_name").alias("name")).distinct()
    rn = records.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("name")).distinct()
    only_p = pn.join(rn, "name", "left_anti").select("name", F.lit("only_in_boundaries").alias("issue"),
                                                     F.lit(1).cast("bigint").alias("n"))
    only_r = rn.join(pn, "name", "left_anti").select("name", F.lit("only_in_records").alias("issue"),
                                                     F.lit(1).cast("bigint").alias("n"))
    dup = (polys.groupBy(F.col("nhood_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("name", F.lit("duplicate_name").alias("issue"), "n"))
    return only_p.unionByName(only_r).unionByName(dup)


def outside_audit(df: DataFrame, polys: DataFrame, lng_col: str, lat_col: str,
                  sw_lng: float, sw_lat: float, ne_lng: float, ne_lat: float,
                  name_col: str = "neighborhood") -> DataFrame:
    """Counts of rows outside the area box, with NULL name, and inside no polygon."""
    labelled = label_points(df, polys, lng_col, lat_col, out_col="_k")
    lng, lat = F.col(lng_col), F.col(lat_col)
    outside = ~(lng.between(sw_lng, ne_lng) & lat.between(sw_lat, ne_lat))
    return labelled.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(lng.isNull() | lat.isNull()).alias("no_coords"),
        F.count_if(outside).alias("outside_box"),
        F.count_if(F.col(name_col).isNull()).alias("null_name"),
        F.count_if(F.col("_k").isNull()).alias("in_no_polygon"))


# ---- J9 ----------------------------------------------------------------------------
def centre_cells(c: DataFrame, levels: dict[int, int]) -> DataFrame:
    """The grid cells of each centre's box at the level of its radius."""
    at = c.where("_raw is not null").withColumn("_lv", _level_in_use(F.col("_raw"), levels))
    return _cells(at, F.pow(F.lit(2.0), F.col("_lv")), "_minx", "_miny", "_maxx", "_maxy").select(
        "_lv", "_cx", "_cy", "centre", "radius", "_clat", "_clng", "_rkm").distinct()


def radius_match(points: DataFrame, centres: DataFrame, lng_col: str = "lng", lat_col: str = "lat",
                 centre_col: str = "centre", radius_col: str = "radius") -> DataFrame:
    """Points within the radius of any centre, tagged with that centre.

    ``centres``: ``centre`` text ``"lat,long"`` and ``radius`` text (``"1mi"``/``"2km"``).
    A point near several centres yields several rows, each tagged with the
    search parameter text ``query_geo = "lat,long,radius"`` (P17).  Range join: each
    centre is expanded to the cells its circle's box covers, at the grid level of
    its own radius; points probe the levels in use, join on their cell there, and
    the exact haversine test runs.
    """
    c = centres.select(
        F.col(centre_col).alias("centre"), F.col(radius_col).alias("radius"),
        F.split(centre_col, ",").getItem(0).cast("double").alias("_clat"),
        F.split(centre_col, ",").getItem(1).cast("double").alias("_clng"),
        parse_radius_km(radius_col).alias("_rkm"))
    dlat = F.col("_rkm") / F.lit(111.0)
    reach = F.abs(F.col("_clat")) + dlat
    # the circle's extreme longitudes; all of them when it holds a pole
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(dlat)) / F.cos(F.radians(F.col("_clat"))))))
    dlng = F.when(reach >= 90, F.lit(180.0)).otherwise(F.least(half * 1.01, F.lit(180.0)))
    west, east = F.col("_clng") - dlng, F.col("_clng") + dlng
    box = lambda lo, hi: F.struct(F.greatest(lo, F.lit(-180.0)).alias("lo"), F.least(hi, F.lit(180.0)).alias("hi"))
    # a box over the antimeridian goes on at the other side
    boxes = F.filter(F.array(box(west, east), box(west + 360, F.lit(180.0)), box(F.lit(-180.0), east - 360)), lambda b: b["lo"] <= b["hi"])
    c = (c.withColumn("_box", F.explode(F.when(dlng >= 180, F.array(box(F.lit(-180.0), F.lit(180.0)))).otherwise(boxes)))
          .withColumn("_minx", F.col("_box.lo")).withColumn("_maxx", F.col("_box.hi")).drop("_box")
          .withColumns({"_miny": F.col("_clat") - dlat, "_maxy": F.col("_clat") + dlat, "_dlat": dlat, "_dlng": dlng}))
    # each centre's cells are as wide as its own circle; a wide box near a pole has eight columns
    c = cut_lineage(c.withColumn("_raw", _level(F.greatest(F.col("_dlat"), F.col("_dlng") / 8, F.lit(1e-6)))), "centres")
    levels = merge_levels([r[0] for r in c.select("_raw").where("_raw is not null").distinct().collect()])
    cc = centre_cells(c, levels)
    n = cc.count()
    cc = F.broadcast(cc) if n * 96 <= DEFAULT_BROADCAST_LIMIT else cc
    side = F.pow(F.lit(2.0), F.col("_lv"))
    probes = F.array(*[F.lit(x) for x in sorted(set(levels.values())) or [0]])
    pts = points.withColumn("_lv", F.explode(probes)).withColumns({"_cx": F.floor(F.col(lng_col) / side), "_cy": F.floor(F.col(lat_col) / side)})
    d = haversine_km(F.col(lat_col), F.col(lng_col), F.col("_clat"), F.col("_clng"))
    return (pts.join(cc, ["_lv", "_cx", "_cy"]).where(d <= F.col("_rkm"))
               .withColumn("query_geo", geo_param_text(F.split("centre", ",").getItem(0),
                                                       F.split("centre", ",").getItem(1), F.col("radius")))
               .drop("_lv", "_cx", "_cy", "_clat", "_clng", "_rkm"))
