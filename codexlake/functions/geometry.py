"""Geometry of point arrays: boxes and areas as columns, hulls and overlaps in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def box(points: str) -> dict[str, Column]:
    """``x0 y0 x1 y1`` of an array of points; null for null and empty arrays."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def shoelace(points: str) -> Column:
    """Area of a polygon; 0 for fewer than three points, null for null."""
    n = F.size(points)
    twice = F.expr(f"aggregate(transform(sequence(1, size({points})), i -> {points}[i - 1][0] * {points}[i % size({points})][1] - {points}[i % size({points})][0] * {points}[i - 1][1]), 0D, (a, x) -> a + x)")
    return F.when(n >= 3, F.abs(twice) / 2).when(n >= 0, F.lit(0.0))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost lowest point, without collinear points.

    The outline is wrapped: from each corner the next one is the point that has no other to its right, the farthest
    of those in line; every step looks at all points at once.
    """
    p = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p
    corners = [0]
    while len(corners) <= len(p):
        ways = p - p[corners[-1]]
        length = np.hypot(*ways.T)
        angle = np.arctan2(ways[:, 1], ways[:, 0])
        heading = -np.pi / 2 if len(corners) == 1 else np.arctan2(*(p[corners[-1]] - p[corners[-2]])[::-1])
        turn = np.where(length > 0, np.round((angle - heading) % (2 * np.pi), 9) % np.round(2 * np.pi, 9), np.inf)
        step = int(np.lexsort((-length, turn))[0])
        if step == 0:
            break
        corners.append(step)
    return p[corners]


def area(points: np.ndarray) -> float:
    p = np.asarray(points, dtype=float).reshape(-1, 2)
    return abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) / 2 if len(p) > 2 else 0.0


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A polygon clipped to a convex counter-clockwise window, edge by edge."""
    out = np.asarray(subject, dtype=float).reshape(-1, 2)
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for p, q, s, t in zip(out, np.roll(out, -1, axis=0), side, np.roll(side, -1), strict=True):
            if s >= 0:
                kept.append(p)
            if (s > 0 > t) or (s < 0 < t):
                kept.append(p + (q - p) * s / (s - t))
        out = np.array(kept).reshape(-1, 2)
    return out


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two convex counter-clockwise polygons share."""
    return area(clip(a, b)) if len(a) > 2 and len(b) > 2 else 0.0


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of the convex hulls."""
    return float(overlaps([a], [b])[0, 0])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection over union of the convex hulls of all shapes of two lists: each hull once, exact areas only where boxes meet."""
    out = np.zeros((len(left), len(right)))
    if not out.size:
        return out
    hulls = [[hull(x) for x in side] for side in (left, right)]
    low, high = (([np.array([f(h) for h in side]) for side in hulls]) for f in (lambda h: h.min(axis=0), lambda h: h.max(axis=0)))
    areas = [np.array([area(h) for h in side]) for side in hulls]
    meet = (np.minimum(high[0][:, None], high[1][None]) > np.maximum(low[0][:, None], low[1][None])).all(axis=2)
    for i, j in zip(*np.nonzero(meet), strict=True):
        common = shared_area(hulls[0][i], hulls[1][j])
        whole = areas[0][i] + areas[1][j] - common
        out[i, j] = common / whole if whole > 0 else 0.0
    return out


def y_at(line: np.ndarray, x: float) -> float:
    """Height of a polyline at ``x``, held constant beyond its ends; the middle of a vertical edge."""
    p = np.asarray(line, dtype=float)
    p = p[np.argsort(p[:, 0], kind="stable")]
    same = p[:, 0] == x
    if same.sum() > 1:
        return float((p[same, 1].min() + p[same, 1].max()) / 2)
    return float(np.interp(x, p[:, 0], p[:, 1]))


def inside(point: tuple[float, float], polygon: np.ndarray) -> bool:
    """Whether a point lies in a polygon, by crossings."""
    p = np.asarray(polygon, dtype=float)
    q = np.roll(p, -1, axis=0)
    x, y = point
    crosses = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
    return bool((crosses & (x < at)).sum() % 2)


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Polyline without the points that stand nearer to the line through their neighbours than ``tolerance``."""
    p = np.asarray(line, dtype=float)
    keep = np.zeros(len(p), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * (p[a + 1 : b, 1] - p[a, 1]) - d[1] * (p[a + 1 : b, 0] - p[a, 0])) / length if length else np.hypot(*(p[a + 1 : b] - p[a]).T)
        far = int(np.argmax(off))
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return p[keep]


def hull_area(points: str) -> Column:
    """Area of the convex hull of an array of points; null for null."""

    def areas(values: pd.Series) -> pd.Series:
        return values.map(lambda v: area(hull(np.array([list(x) for x in v]))) if v is not None and len(v) else None)

    return F.pandas_udf(areas, "double")(points)
