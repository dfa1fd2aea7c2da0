"""Outlines and baselines of lines: heights along x, shared areas by columns, cuts and merges; whole arrays at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexlake.functions.geometry import area, hull

#: Least width of a baseline that a cut leaves, and least distance of points of a merged one.
MIN_SPAN, MIN_STEP = 10.0, 4.0


def _array(points: object) -> np.ndarray:
    return np.asarray([tuple(p) for p in points] if points is not None else [], dtype=float).reshape(-1, 2)


def heights_at(line: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Heights of a polyline at many x, held flat beyond its ends; of points above each other the upper one counts."""
    p = _array(line)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    x, first = np.unique(p[:, 0], return_index=True)
    return np.interp(xs, x, p[first, 1])


def baseline_gap(a: np.ndarray, b: np.ndarray, samples: int = 11) -> float:
    """Mean vertical distance of two baselines over the x range of both; infinite for one without two points."""
    a, b = _array(a), _array(b)
    if min(len(a), len(b)) < 2:
        return float("inf")
    xs = np.linspace(min(a[:, 0].min(), b[:, 0].min()), max(a[:, 0].max(), b[:, 0].max()), samples)
    return float(np.abs(heights_at(a, xs) - heights_at(b, xs)).mean())


def baseline_relation(a: np.ndarray, b: np.ndarray, samples: int = 9) -> tuple[float, float]:
    """Share of the shorter baseline's width that both have in common, and their median vertical distance there."""
    a, b = _array(a), _array(b)
    low, high = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 0].max(), b[:, 0].max())
    width = min(np.ptp(a[:, 0]), np.ptp(b[:, 0]))
    if high <= low or width <= 0:
        return 0.0, float("inf")
    xs = np.linspace(low, high, samples)
    return float((high - low) / width), float(np.median(np.abs(heights_at(a, xs) - heights_at(b, xs))))


def extents_at(outline: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest height of an outline at many x; nan where it isn't."""
    p = _array(outline)
    q = np.roll(p, -1, axis=0)
    low, high = np.minimum(p[:, 0], q[:, 0]), np.maximum(p[:, 0], q[:, 0])
    run = q[:, 0] - p[:, 0]
    part = (xs[None] - p[:, :1]) / np.where(run == 0, 1, run)[:, None]
    at = np.where(run[:, None] == 0, p[:, 1:], p[:, 1:] + part * (q - p)[:, 1:])
    inside = (xs[None] >= low[:, None]) & (xs[None] <= high[:, None])
    none = ~inside.any(axis=0)
    top, bottom = np.where(inside, at, np.inf).min(axis=0), np.where(inside, at, -np.inf).max(axis=0)
    return np.where(none, np.nan, top), np.where(none, np.nan, bottom)


def shared_by_columns(a: np.ndarray, b: np.ndarray, steps: int = 4) -> float:
    """Area that two outlines share, from the heights they share at each x; exact for one upper and one lower edge."""
    a, b = _array(a), _array(b)
    if min(len(a), len(b)) < 3:
        return 0.0
    low, high = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 0].max(), b[:, 0].max())
    if high <= low:
        return 0.0
    corners = np.unique(np.clip(np.concatenate([[low, high], a[:, 0], b[:, 0]]), low, high))
    xs = np.unique(np.concatenate([corners[:-1] + np.diff(corners) * k / steps for k in range(steps)] + [corners[-1:]]))
    (top_a, end_a), (top_b, end_b) = extents_at(a, xs), extents_at(b, xs)
    shared = np.nan_to_num(np.maximum(0, np.minimum(end_a, end_b) - np.maximum(top_a, top_b)))
    return float(((shared[1:] + shared[:-1]) / 2 * np.diff(xs)).sum())


def cut(outline: np.ndarray, at: float, axis: int, below: bool) -> np.ndarray:
    """The part of an outline on one side of a vertical (axis 0) or horizontal line, its edges cut there."""
    p = _array(outline)
    if not len(p):
        return p
    q = np.roll(p, -1, axis=0)
    side = (at - p[:, axis]) if below else (p[:, axis] - at)
    beyond = np.roll(side, -1)
    crosses = (side < 0) != (beyond < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        where = p + (q - p) * (side / (side - beyond))[:, None]
    rows = np.stack([p, np.where(crosses[:, None], where, 0)], axis=1).reshape(-1, 2)
    return rows[np.stack([side >= 0, crosses], axis=1).ravel()]


def cut_between(outline: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    out = _array(outline)
    if low is not None:
        out = cut(out, low, 0, below=False)
    return out if high is None else cut(out, high, 0, below=True)


def cut_baseline(line: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """A baseline between two x, with points at both cuts; empty if less than ``MIN_SPAN`` is left."""
    p = _array(line)
    if len(p) < 2:
        return p[:0]
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    low, high = (p[0, 0] if low is None else max(low, p[0, 0])), (p[-1, 0] if high is None else min(high, p[-1, 0]))
    if high - low < MIN_SPAN:
        return p[:0]
    ends = np.column_stack([[low, high], heights_at(p, np.array([low, high]))])
    return np.vstack([ends[:1], p[(p[:, 0] > low) & (p[:, 0] < high)], ends[1:]])


def merged_outline(parts: list[np.ndarray]) -> np.ndarray:
    """One outline around several: their common upper and lower edges over all their corners, or the hull across a gap."""
    parts = [_array(p) for p in parts if len(p)]
    if not parts:
        return np.zeros((0, 2))
    corners = np.unique(np.concatenate([p[:, 0] for p in parts]))
    # Either side of each corner, so that an upright edge stays upright.
    xs = np.unique(np.clip(np.concatenate([corners - 1e-6, corners + 1e-6]), corners[0], corners[-1]))
    edges = [extents_at(p, xs) for p in parts]
    middle = (corners[1:] + corners[:-1]) / 2
    bridged = len(middle) and np.isnan([extents_at(p, middle)[0] for p in parts]).all(axis=0).any()
    if len(xs) < 2 or bridged:
        return hull(np.vstack(parts))
    top, bottom = np.nanmin([t for t, _ in edges], axis=0), np.nanmax([b for _, b in edges], axis=0)
    return without_repeats(np.round(np.vstack([np.column_stack([xs, top]), np.column_stack([xs, bottom])[::-1]]), 4))


def merged_baseline(parts: list[np.ndarray]) -> np.ndarray:
    """The points of several baselines from left to right, those nearer than ``MIN_STEP`` to the one before left out; the last stays."""
    p = np.vstack([_array(x) for x in parts]) if parts else np.zeros((0, 2))
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    kept: list[int] = []
    for i in range(len(p)):
        if not kept or p[i, 0] - p[kept[-1], 0] >= MIN_STEP:
            kept.append(i)
    if len(p) > 1 and kept[-1] != len(p) - 1 and len(kept) > 1:
        kept[-1] = len(p) - 1
    return p[kept]


def without_repeats(ring: np.ndarray) -> np.ndarray:
    """A ring without repeated neighbours; its last point isn't its first."""
    p = _array(ring)
    return p[(p != np.roll(p, 1, axis=0)).any(axis=1)] if len(p) > 1 else p


def default_baseline(outline: np.ndarray, fraction: float = 0.75) -> np.ndarray:
    """A level baseline at a fraction of the outline's height, for lines that have none."""
    p = _array(outline)
    if not len(p):
        return p
    (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
    return np.array([[x0, y0 + fraction * (y1 - y0)], [x1, y0 + fraction * (y1 - y0)]])


def page_baseline(line: np.ndarray, outline: np.ndarray, width: int, height: int) -> np.ndarray:
    """A baseline fit for PAGE XML: whole numbers inside the page and the outline's box, x strictly rising.

    A line that has no two such points left gets the default one of its outline.
    """
    low, high = np.zeros(2), np.array([width - 1, height - 1], dtype=float)
    box = _array(outline)
    if len(box):
        low, high = np.maximum(low, box.min(axis=0)), np.minimum(high, box.max(axis=0))
    p = _array(line)
    for given in (p, default_baseline(outline)):
        q = np.rint(np.clip(given, low, high)) if len(given) else given
        q = q[np.argsort(q[:, 0], kind="stable")]
        q = q[np.concatenate([[True], np.diff(q[:, 0]) > 0])] if len(q) else q
        if len(q) > 1:
            return q.astype(int)
    return np.zeros((0, 2), dtype=int)


def softmax(scores: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Probabilities of each row of scores."""
    s = np.asarray(scores, dtype=float) / temperature
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def greatest_difference(a: str, b: str) -> Column:
    """Greatest difference of a coordinate of two arrays of points of equal length; null for unequal ones."""
    parts = F.flatten(F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda x, y: F.abs(x - y))))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda m, x: F.greatest(m, x)))


def padded_box(points: str, pad: int, width: str, height: str) -> Column:
    """Box around points with a margin, inside the page, as ``x0, y0, x1, y1``."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    low = [F.greatest(F.lit(0), F.floor(F.array_min(v)).cast("int") - pad) for v in (xs, ys)]
    high = [F.least(F.col(m), F.ceil(F.array_max(v)).cast("int") + pad) for v, m in ((xs, width), (ys, height))]
    return F.array(*low, *high)


def closed_area(points: np.ndarray) -> float:
    """Area of an outline without its repeated neighbours."""
    return area(without_repeats(points))
