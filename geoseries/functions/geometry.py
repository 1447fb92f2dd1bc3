"""Geometry predicates as Column expressions (no UDFs).

Rings are ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>``; edges are
``ARRAY<STRUCT<x1, y1, x2, y2>>`` between consecutive ring points.
Everything folds over edges with the SQL ``aggregate`` higher-order function,
so the work stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def ring_from_coords(coords: Column) -> Column:
    """``[[x, y], ...]`` -> closed ring of structs (first point repeated at the end)."""
    pts = F.transform(coords, lambda p: F.struct(p.getItem(0).alias("x"), p.getItem(1).alias("y")))
    first = F.element_at(pts, 1)
    last = F.element_at(pts, -1)
    return F.when((first.x == last.x) & (first.y == last.y), pts) \
            .otherwise(F.concat(pts, F.array(first)))


def ring_edges(ring: Column) -> Column:
    """Closed ring -> array of edges (x1, y1, x2, y2)."""
    idx = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.transform(idx, lambda i: F.struct(
        F.element_at(ring, i).x.alias("x1"), F.element_at(ring, i).y.alias("y1"),
        F.element_at(ring, i + 1).x.alias("x2"), F.element_at(ring, i + 1).y.alias("y2")))


def bbox(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs = F.transform(ring, lambda p: p.x)
    ys = F.transform(ring, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def on_edge(e: Column, px: Column, py: Column) -> Column:
    cross = (e.x2 - e.x1) * (py - e.y1) - (e.y2 - e.y1) * (px - e.x1)
    return ((cross == 0)
            & (px >= F.least(e.x1, e.x2)) & (px <= F.greatest(e.x1, e.x2))
            & (py >= F.least(e.y1, e.y2)) & (py <= F.greatest(e.y1, e.y2)))


def ray_crosses(e: Column, px: Column, py: Column) -> Column:
    straddles = (e.y1 > py) != (e.y2 > py)
    x_at = F.when(e.y2 != e.y1, (e.x2 - e.x1) * (py - e.y1) / (e.y2 - e.y1) + e.x1)
    return straddles & F.coalesce(px < x_at, F.lit(False))


def ring_fold(edges: Column, px: Column, py: Column, finish: Callable[[Column], Column] = lambda a: a) -> Column:
    """One pass over the edges: struct(n = ray crossings, on = point on an edge).
    ``finish`` takes what is asked of it inside the fold: a column that names the
    struct twice folds twice."""
    init = F.struct(F.lit(0).alias("n"), F.lit(False).alias("on"))
    return F.aggregate(
        edges, init,
        lambda a, e: F.struct(
            (a.n + F.when(ray_crosses(e, px, py), 1).otherwise(0)).alias("n"),
            (a.on | on_edge(e, px, py)).alias("on")), finish)


def covers_point(edges: Column, px: Column, py: Column) -> Column:
    """Closed-region test: inside the ring **or on its boundary** (even-odd rule)."""
    return ring_fold(edges, px, py, lambda a: a.on | (a.n % 2 == 1))


def strictly_inside(edges: Column, px: Column, py: Column) -> Column:
    """Inside the ring and not on its boundary."""
    return ring_fold(edges, px, py, lambda a: ~a.on & (a.n % 2 == 1))


def clearly_inside(edges: Column, px: Column, py: Column, tol: float) -> Column:
    """Inside the ring and farther than ``tol`` from its boundary."""
    def close(e):
        dx, dy = e.x2 - e.x1, e.y2 - e.y1
        t = F.try_divide((px - e.x1) * dx + (py - e.y1) * dy, dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
        return F.hypot(px - e.x1 - t * dx, py - e.y1 - t * dy) <= tol
    return ~F.exists(edges, close) & (ring_fold(edges, px, py).n % 2 == 1)


def piece_midpoints(e: Column, others: Column) -> Column:
    """Midpoints of the pieces into which the lines and ends of ``others`` cut the
    edge ``e`` (a cut too many only makes a shorter piece)."""
    dx, dy = e.x2 - e.x1, e.y2 - e.y1

    def cuts(f):
        den = dx * (f.y2 - f.y1) - dy * (f.x2 - f.x1)
        meet = F.try_divide((f.x1 - e.x1) * (f.y2 - f.y1) - (f.y1 - e.y1) * (f.x2 - f.x1), den)
        along = [F.try_divide((x - e.x1) * dx + (y - e.y1) * dy, dx * dx + dy * dy) for x, y in ((f.x1, f.y1), (f.x2, f.y2))]
        return F.array(meet, *along)
    inner = F.filter(F.flatten(F.transform(others, cuts)), lambda t: (t > 0) & (t < 1))
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
    return F.transform(F.sequence(F.lit(1), F.size(ts) - 1), lambda i: F.struct(
        (e.x1 + dx * (F.element_at(ts, i) + F.element_at(ts, i + 1)) / 2).alias("x"),
        (e.y1 + dy * (F.element_at(ts, i) + F.element_at(ts, i + 1)) / 2).alias("y")))


def interior_point(edges: Column) -> Column:
    """A point inside the ring: halfway between the first two crossings of a
    horizontal line between its two lowest vertex heights (NULL for a flat ring)."""
    ys = F.array_sort(F.array_distinct(F.transform(edges, lambda e: e.y1)))
    y = (F.try_element_at(ys, F.lit(1)) + F.try_element_at(ys, F.lit(2))) / 2
    xs = F.array_sort(F.transform(F.filter(edges, lambda e: (e.y1 > y) != (e.y2 > y)),
                                  lambda e: (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1))
    return F.struct(((F.try_element_at(xs, F.lit(1)) + F.try_element_at(xs, F.lit(2))) / 2).alias("x"), y.alias("y"))


def orient(ax, ay, bx, by, cx, cy) -> Column:
    """Sign of the orientation determinant of (a, b, c): -1, 0, 1."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    rl1, rl2 = F.radians(lat1), F.radians(lat2)
    dlat = F.radians(lat2 - lat1)
    dlng = F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(rl1) * F.cos(rl2) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
