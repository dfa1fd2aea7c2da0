"""Matching of shapes: grid join of boxes, greedy and optimal one-to-one matching, one-dimensional clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def box_pairs(boxes: DataFrame, group: Sequence[str], key: str, cell: float = 256.0) -> DataFrame:
    """Pairs of boxes of a group that overlap: ``group``, ``a``, ``b`` (a < b) and ``shared`` area.

    Each box goes to the grid cells it touches; boxes meet only in a cell, and a pair is kept in the cell that
    holds the upper left corner of what they share, so nothing is emitted twice and no group is crossed with itself.
    """
    def spread(side: str) -> DataFrame:
        cells = boxes.select(*group, F.col(key).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))).alias("cx"), "y0", "y1")
        return cells.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)))).drop("y0", "y1")

    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    right, bottom = F.least("a_x1", "b_x1"), F.least("a_y1", "b_y1")
    met = spread("a").join(spread("b"), [*group, "cx", "cy"]).where((F.col("a") < F.col("b")) & (left < right) & (top < bottom))
    first = (F.floor(left / cell) == F.col("cx")) & (F.floor(top / cell) == F.col("cy"))
    return met.where(first).select(*group, "a", "b", ((right - left) * (bottom - top)).alias("shared"))


def greedy_match(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs by falling score, each row and column once; ties by row, then column."""
    rows, cols = np.nonzero(scores >= least)
    order = np.lexsort((cols, rows, -scores[rows, cols]))
    used_r, used_c, out = set(), set(), []
    for k in order:
        i, j = int(rows[k]), int(cols[k])
        if i not in used_r and j not in used_c:
            used_r.add(i)
            used_c.add(j)
            out.append((i, j))
    return out


def optimal_match(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """One-to-one matching with most pairs of at least ``least``, then the greatest total score.

    Shortest augmenting paths with potentials over a square cost matrix.
    """
    n = max(scores.shape, default=0)
    if not n or not scores.size:
        return []
    allowed = np.zeros((n, n), dtype=bool)
    allowed[: scores.shape[0], : scores.shape[1]] = scores >= least
    value = np.zeros((n, n))
    value[: scores.shape[0], : scores.shape[1]] = scores
    big = float(np.abs(value).max()) * n + 1
    cost = np.where(allowed, -(big + value), 0.0)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        best = np.full(n + 1, np.inf)
        back = np.zeros(n + 1, dtype=int)
        seen = np.zeros(n + 1, dtype=bool)
        while True:
            seen[j] = True
            free = ~seen[1:]
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = free & (reduced < best[1:])
            best[1:][better] = reduced[better]
            back[1:][better] = j
            nxt = int(np.argmin(np.where(free, best[1:], np.inf))) + 1
            delta = best[nxt]
            u[owner[seen]] += delta
            v[seen] -= delta
            best[1:][free] -= delta
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, n + 1) if allowed[owner[j] - 1, j - 1])


def cluster_centres(values: Sequence[float], k: int, rounds: int = 100) -> list[float]:
    """Centres of one-dimensional clusters, begun at evenly spaced quantiles, in rising order."""
    x = np.sort(np.asarray(values, dtype=float))
    if not len(x):
        return []
    centres = np.unique(np.quantile(x, (np.arange(k) + 0.5) / k))
    for _ in range(rounds):
        owner = np.searchsorted((centres[1:] + centres[:-1]) / 2, x)
        moved = np.array([x[owner == i].mean() if (owner == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres.tolist()


def reading_order(boxes: np.ndarray, least: float = 0.5) -> list[int]:
    """Order of line boxes ``x0 y0 x1 y1``: columns by x-overlap components from left to right, lines from top."""
    n = len(boxes)
    width = np.maximum(boxes[:, 2] - boxes[:, 0], 1e-9)
    column = np.full(n, -1)
    for start in range(n):
        if column[start] >= 0:
            continue
        column[start] = start
        todo = [start]
        while todo:
            i = todo.pop()
            shared = np.minimum(boxes[i, 2], boxes[:, 2]) - np.maximum(boxes[i, 0], boxes[:, 0])
            near = (shared / np.minimum(width[i], width) >= least) & (column < 0)
            column[near] = start
            todo += np.flatnonzero(near).tolist()
    left = {c: boxes[column == c, 0].min() for c in set(column.tolist())}
    return sorted(range(n), key=lambda i: (left[int(column[i])], int(column[i]), boxes[i, 1], boxes[i, 0], i))
