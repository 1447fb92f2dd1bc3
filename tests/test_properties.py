"""Randomised checks against independent brute force (exact integer geometry)."""
import random

from geoseries.operators import geo


def _polys_from_rings(spark, rings):
    rows = [(i, i, f"P{i}", [{"x": float(x), "y": float(y)} for x, y in ring + [ring[0]]])
            for i, ring in enumerate(rings)]
    df = spark.createDataFrame(rows, "pos int, num int, name string, ring array<struct<x:double,y:double>>")
    return geo.polygons_from_rings(df, "pos", "num", "name", "ring")


def _rects(seed, n=40, size=8):
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        x0, y0 = rnd.randint(0, size - 1), rnd.randint(0, size - 1)
        x1, y1 = rnd.randint(x0 + 1, size), rnd.randint(y0 + 1, size)
        out.append((x0, y0, x1, y1))
    return out


def test_adjacency_matches_rectangle_brute_force(spark):
    rects = _rects(7)
    rings = [[(a, b), (c, b), (c, d), (a, d)] for a, b, c, d in rects]
    got = {(r.centre, r.neighbour) for r in geo.adjacency(_polys_from_rings(spark, rings)).collect()}
    want = set()
    for i, (a0, b0, a1, b1) in enumerate(rects):
        for j, (c0, d0, c1, d1) in enumerate(rects):
            if i == j:
                continue
            closed = a0 <= c1 and c0 <= a1 and b0 <= d1 and d0 <= b1
            interior = a0 < c1 and c0 < a1 and b0 < d1 and d0 < b1
            if closed and not interior:
                want.add((f"{i},P{i}", f"{j},P{j}"))
    assert got == want


def _orient(ax, ay, bx, by, cx, cy):
    v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (v > 0) - (v < 0)


def _in_closed_triangle(t, x, y):
    (ax, ay), (bx, by), (cx, cy) = t
    s = [_orient(ax, ay, bx, by, x, y), _orient(bx, by, cx, cy, x, y), _orient(cx, cy, ax, ay, x, y)]
    return all(v >= 0 for v in s) or all(v <= 0 for v in s)


def test_point_in_polygon_matches_brute_force(spark):
    rnd = random.Random(11)
    shapes = []
    for _ in range(30):
        if rnd.random() < 0.5:
            a, b, c, d = _rects(rnd.randint(0, 10 ** 6), n=1, size=10)[0]
            shapes.append(("rect", (a, b, c, d), [(a, b), (c, b), (c, d), (a, d)]))
        else:
            while True:
                t = [(rnd.randint(0, 10), rnd.randint(0, 10)) for _ in range(3)]
                if _orient(*t[0], *t[1], *t[2]) != 0:
                    break
            shapes.append(("tri", t, t))
    polys = _polys_from_rings(spark, [s[2] for s in shapes])
    pts = [(i, rnd.randint(-1, 11) / 1.0, rnd.randint(-1, 11) / 1.0) for i in range(400)]
    pts += [(400 + i, rnd.randint(0, 20) / 2.0, rnd.randint(0, 20) / 2.0) for i in range(400)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r.id: r.k for r in geo.label_points(df, polys, "x", "y", "k").collect()}
    for pid, x, y in pts:
        want = None
        for i, (kind, g, _) in enumerate(shapes):
            inside = (g[0] <= x <= g[2] and g[1] <= y <= g[3]) if kind == "rect" else _in_closed_triangle(g, x, y)
            if inside:
                want = f"{i},P{i}"
                break
        assert got[pid] == want, (pid, x, y)
