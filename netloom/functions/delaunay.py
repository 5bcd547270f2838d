"""Delaunay triangulation of a few thousand points (zone centroids), by insertion."""

from __future__ import annotations


def delaunay_edges(points: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Edges (i < j) of the Delaunay triangulation of distinct points (Bowyer and Watson's insertion)."""
    n = len(points)
    if n < 3:
        return [(0, 1)] if n == 2 else []
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    span = max(max(xs) - min(xs), max(ys) - min(ys), 1.0) * 1000
    mx, my = (max(xs) + min(xs)) / 2, (max(ys) + min(ys)) / 2
    every = [*points, (mx - 2 * span, my - span), (mx + 2 * span, my - span), (mx, my + 2 * span)]

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = (every[k] for k in t)
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-12:
            return 0.0, 0.0, float("inf")
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + ux, ay + uy, ux * ux + uy * uy

    triangles = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for k in range(n):
        x, y = every[k]
        bad = [t for t, (cx, cy, r) in triangles.items() if (x - cx) ** 2 + (y - cy) ** 2 < r * (1 + 1e-12)]
        border: dict[tuple[int, int], int] = {}
        for t in bad:
            del triangles[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                e = (min(e), max(e))
                border[e] = border.get(e, 0) + 1
        for (i, j), times in border.items():
            if times == 1:
                triangles[(i, j, k)] = circle((i, j, k))
    return sorted({(min(i, j), max(i, j)) for t in triangles for i, j in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])) if i < n and j < n})
