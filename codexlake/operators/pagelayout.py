"""Layout of a page's lines: columns, rows and reading order, fragments, overlaps, defects.  A page is one small group.

A page is a table of boxes ``x0 y0 x1 y1`` (and outlines, baselines) in numpy; every order has a geometric tie-break, so
results don't depend on the order of the input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from codexlake.functions.geometry import area, clip, hull
from codexlake.functions.outlines import baseline_gap, cut, cut_baseline, cut_between, heights_at, merged_baseline, merged_outline, shared_by_columns, without_repeats

# Fixed values of the column and row rules: narrow and wide lines against the median width, shared x range of a column and
# of a spanning line, shared y range of a row, and tall lines against the median height.
NARROW, WIDE, SAME_COLUMN, SPANS, SAME_ROW, TALL = 0.5, 1.5, 0.5, 0.1, 0.5, 1.8
# Fixed values of row fragments: gap and overlap against the median height, heights against each other.
GAP, LAP, HEIGHTS = 0.25, 0.1, 2.0
# Fixed values of overlaps: share of the smaller outline that is a defect, share of the larger one that is a duplicate, passes.
DEFECT, DUPLICATE, PASSES = 0.2, 0.5, 100
# Fixed values of defects: column bands, suspects, fragments.
SLICES, COVERED, RUNNING = 200, 0.35, 0.15
THIN, FEW_CORNERS, SQUAT = 0.06, 6, 0.6
COLLINEAR, NEAR, LOPSIDED, REACHES = 0.4, 1.5, 0.6, 0.2


@dataclass(slots=True)
class Layout:
    """Columns from left to right, each with its rows from top to bottom, and the lines that span columns."""

    rows: list[list[list[int]]] = field(default_factory=list)
    builders: list[list[int]] = field(default_factory=list)
    ranges: list[tuple[float, float]] = field(default_factory=list)
    spanning: list[int] = field(default_factory=list)


def _share(low: np.ndarray, high: np.ndarray, a: float, b: float) -> np.ndarray:
    return np.minimum(high, b) - np.maximum(low, a)


def _upper_middle(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else 0.0


def columns_and_rows(boxes: np.ndarray, rtl: bool = False) -> Layout:
    """Columns by transitive x overlap of the lines of common width; narrow lines go to the nearest column, wide ones to the
    only column they overlap or, over several, stand for themselves."""
    out = Layout()
    if not len(boxes):
        return out
    x0, y0, x1, y1 = np.asarray(boxes, dtype=float).T
    width, height, cx, cy = x1 - x0, y1 - y0, (x0 + x1) / 2, (y0 + y1) / 2
    middle = _upper_middle(width)
    narrow, wide = width < NARROW * middle, width > WIDE * middle
    builders = np.flatnonzero(~(narrow | wide))
    label = np.full(len(boxes), -1)
    for seed in builders:
        front = [seed] if label[seed] < 0 else []
        while front:
            i = front.pop()
            label[i] = seed
            free = builders[label[builders] < 0]
            free = free[_share(x0[free], x1[free], x0[i], x1[i]) >= SAME_COLUMN * np.minimum(width[free], width[i])]
            label[free] = seed
            front += free.tolist()
    found = [builders[label[builders] == s] for s in dict.fromkeys(label[builders].tolist())]
    found.sort(key=lambda m: (x0[m].min(), x1[m].max(), sorted(zip(cx[m], cy[m], strict=True))))
    members = [m.tolist() for m in found]
    out.builders = [m.tolist() for m in found]
    low, high = np.array([x0[m].min() for m in found]), np.array([x1[m].max() for m in found])

    def nearest(i: int) -> int:
        return int(np.argmin(np.maximum(0, np.maximum(low - x1[i], x0[i] - high))))

    for i in np.flatnonzero(wide):
        over = np.flatnonzero(_share(low, high, x0[i], x1[i]) > SPANS * (high - low))
        if len(over) > 1:
            out.spanning.append(int(i))
            continue
        at = int(over[0]) if len(over) else nearest(i)
        members[at].append(int(i))
        low[at], high[at] = min(low[at], x0[i]), max(high[at], x1[i])
    for i in np.flatnonzero(narrow):
        members[nearest(i)].append(int(i))
    place = [tuple(b) for b in np.asarray(boxes, dtype=float).tolist()]
    out.spanning.sort(key=lambda i: (cy[i], cx[i], place[i]))
    for own, founders in zip(members, out.builders, strict=True):
        typical = _upper_middle(height[founders])
        rows: list[list[int]] = []
        spans = np.zeros((0, 4))
        for i in sorted(own, key=lambda i: (cy[i], cx[i], place[i])):
            tall = typical > 0 and height[i] > TALL * typical
            same = np.zeros(len(rows), dtype=bool)
            if len(rows):
                deep = _share(spans[:, 1], spans[:, 3], y0[i], y1[i]) >= SAME_ROW * np.minimum(height[i], spans[:, 3] - spans[:, 1])
                beside = _share(spans[:, 0], spans[:, 2], x0[i], x1[i]) < SAME_COLUMN * np.minimum(width[i], spans[:, 2] - spans[:, 0])
                same = deep & beside
            if tall and same.any():  # joins the first row it reaches and doesn't widen it
                rows[int(np.argmax(same))].append(i)
            elif not tall and len(rows) and same[-1]:
                rows[-1].append(i)
                spans[-1] = [min(spans[-1, 0], x0[i]), min(spans[-1, 1], y0[i]), max(spans[-1, 2], x1[i]), max(spans[-1, 3], y1[i])]
            else:
                rows.append([i])
                spans = np.vstack([spans, [x0[i], y0[i], x1[i], y1[i]]])
        order = sorted(range(len(rows)), key=lambda r: (min(cy[rows[r]]), spans[r, 1], spans[r, 3], sorted(place[i] for i in rows[r])))
        out.rows.append([sorted(rows[r], key=lambda i: (-cx[i] if rtl else cx[i], place[i])) for r in order])
    out.ranges = list(zip(low.tolist(), high.tolist(), strict=True))
    return out


def line_order(boxes: np.ndarray, rtl: bool = False) -> list[int]:
    """Reading order: spanning lines part the page into bands; in each, column after column, row after row."""
    layout = columns_and_rows(boxes, rtl)
    if not len(boxes):
        return []
    b = np.asarray(boxes, dtype=float)
    cy = (b[:, 1] + b[:, 3]) / 2
    centres = cy[layout.spanning]
    columns = layout.rows[::-1] if rtl else layout.rows
    flat = [i for rows in columns for row in rows for i in row]
    band = np.searchsorted(centres, cy[flat], side="left")
    out: list[int] = []
    for k in range(len(centres) + 1):
        out += [i for i, at in zip(flat, band, strict=True) if at == k]
        out += layout.spanning[k : k + 1]
    return out


def row_runs(boxes: np.ndarray, layout: Layout | None = None) -> list[list[int]]:
    """Runs of fragments that stand side by side in a row and are of like height, from left to right."""
    b = np.asarray(boxes, dtype=float)
    layout = layout or columns_and_rows(b)
    height = b[:, 3] - b[:, 1] if len(b) else np.zeros(0)
    typical = float(np.median(height)) if len(b) else 1.0
    runs: list[list[int]] = []
    for row in (row for rows in layout.rows for row in rows):
        run: list[int] = []
        for i in sorted(row, key=lambda i: (b[i, 0], b[i, 1], tuple(b[i]))):
            with_it = [*run, i]
            gap = b[i, 0] - b[run, 2].max() if run else 0.0
            if run and -LAP * typical <= gap <= GAP * typical and height[with_it].max() <= HEIGHTS * height[with_it].min():
                run = with_it
            else:
                runs += [run] if run else []
                run = [i]
        runs += [run] if run else []
    return runs + [[i] for i in layout.spanning]


def resolve_overlaps(outlines: list[np.ndarray], baselines: list[np.ndarray], scores: np.ndarray, spacing: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Convex outlines cut apart until nothing changes: the outlines, which are dropped and which stay unresolved.

    Pairs that share a fifth of the smaller one, largest share first: baselines half a line apart are cut between them,
    unless a side would lose more than half; lines drawn twice lose the one of lower score (ties: the later).
    """
    shapes = [hull(o) for o in outlines]
    lines = [np.asarray(x, dtype=float) for x in baselines]
    sizes = np.array([area(s) for s in shapes])
    dropped, stuck = np.zeros(len(shapes), dtype=bool), np.zeros(len(shapes), dtype=bool)

    def shared(i: int, j: int) -> float:
        return area(clip(shapes[i], shapes[j])) if len(shapes[i]) > 2 and len(shapes[j]) > 2 else 0.0

    def near() -> list[tuple[float, int, int]]:
        live = [i for i in np.flatnonzero(~dropped) if len(shapes[i]) > 2]
        if len(live) < 2:
            return []
        box = np.array([[*shapes[i].min(axis=0), *shapes[i].max(axis=0)] for i in live])
        order = np.argsort(box[:, 1], kind="stable")
        found = []
        for k, i in enumerate(order):  # a sweep from the top: only lines that begin above this one's end
            rest = order[k + 1 :]
            rest = rest[: np.searchsorted(box[rest, 1], box[i, 3], side="left")]
            rest = rest[(box[rest, 0] < box[i, 2]) & (box[rest, 2] > box[i, 0])]
            for j in rest:
                a, b = sorted((int(live[i]), int(live[j])))
                ratio = shared(a, b) / max(1e-12, min(sizes[a], sizes[b]))
                if ratio >= DEFECT:
                    found.append((-ratio, a, b))
        return sorted(found)

    def part(i: int, j: int) -> bool:
        ways = [x[-1] - x[0] for x in (lines[i], lines[j])]
        arm = ways[0] + (ways[1] if np.dot(*ways) >= 0 else -ways[1])
        length = np.hypot(*arm)
        if not length:
            return False
        arm /= length
        normal = np.array([-arm[1], arm[0]])
        centre = np.mean([lines[i][0], lines[i][-1], lines[j][0], lines[j][-1]], axis=0)
        turn = np.column_stack([arm, normal])
        pieces = {}
        for k in (i, j):
            above = (lines[k].mean(axis=0) - centre) @ normal <= 0
            if k == j and above == ((lines[i].mean(axis=0) - centre) @ normal <= 0):
                return False
            piece = cut((shapes[k] - centre) @ turn, 0.0, 1, below=above) @ turn.T + centre
            if area(piece) <= 0.5 * sizes[k]:
                return False
            pieces[k] = hull(piece)
        for k, piece in pieces.items():
            shapes[k], sizes[k] = piece, area(piece)
        return True

    for _ in range(PASSES):
        changed = False
        for _, i, j in near():
            if dropped[i] or dropped[j] or shared(i, j) < DEFECT * min(sizes[i], sizes[j]):
                continue
            if baseline_gap(lines[i], lines[j]) < spacing / 2:
                if shared(i, j) > DUPLICATE * max(sizes[i], sizes[j]):
                    dropped[i if scores[j] > scores[i] else j] = changed = True
                else:
                    stuck[[i, j]] = True
            elif part(i, j):
                changed = True
            else:
                stuck[[i, j]] = True
        if not changed:
            break
    for _, i, j in near():
        stuck[[i, j]] = True
    return [without_repeats(s) for s in shapes], dropped, stuck & ~dropped


def suppressed(baselines: list[np.ndarray], pitch: float) -> np.ndarray:
    """Which lines repeat a longer one: less than 0.3 pitch apart, and half the shorter one's width in common."""
    low, high = (np.array([f(np.asarray(b, dtype=float)[:, 0]) for b in baselines]) for f in (np.min, np.max))
    at = np.array([np.asarray(b, dtype=float)[:, 1].mean() for b in baselines])
    kept: list[int] = []
    out = np.zeros(len(baselines), dtype=bool)
    for i in np.argsort(low - high, kind="stable"):
        k = np.array(kept, dtype=int)
        shorter = np.minimum(high[k] - low[k], high[i] - low[i])
        clash = (np.abs(at[k] - at[i]) <= 0.3 * pitch) & (shorter > 0) & (np.minimum(high[k], high[i]) - np.maximum(low[k], low[i]) >= 0.5 * shorter)
        if clash.any():
            out[i] = True
        else:
            kept.append(int(i))
    return out


def topological_order(before: np.ndarray) -> list[int]:
    """Order that keeps ``before[i, j]`` (i reads before j); of what may come next the first in the input, a cycle is cut there."""
    need = np.asarray(before, dtype=bool).sum(axis=0)
    done = np.zeros(len(need), dtype=bool)
    out: list[int] = []
    while len(out) < len(need):
        free = np.flatnonzero(~done & (need <= 0))
        i = int(free[0]) if len(free) else int(np.flatnonzero(~done)[np.argmin(need[~done])])
        done[i] = True
        need = need - before[i]
        out.append(i)
    return out


def inserted_order(kept: np.ndarray, new: np.ndarray) -> list[int]:
    """Reading order of kept lines (in their order, 0..k-1) and new ones (k..): each new line goes after the kept line above it
    in its x range, else before the one below, else to the end; boxes ``x0 y0 x1 y1``."""
    n = len(kept)
    if not n:
        return sorted(range(len(new)), key=lambda i: (new[i][1], new[i][0]))
    kept, slots = np.asarray(kept, dtype=float), []
    mid = (kept[:, 1] + kept[:, 3]) / 2
    for i, b in enumerate(np.asarray(new, dtype=float).reshape(-1, 4)):
        beside = _share(kept[:, 0], kept[:, 2], b[0], b[2]) > 0
        y = (b[1] + b[3]) / 2
        above, below = np.flatnonzero(beside & (mid <= y)), np.flatnonzero(beside & (mid > y))
        slot = above[np.argmax(mid[above])] + 0.5 if len(above) else below[np.argmin(mid[below])] - 0.5 if len(below) else n
        slots.append((slot, y, b[0], n + i))
    return [i for *_, i in sorted([*((float(k), 0.0, 0.0, k) for k in range(n)), *slots])]


@dataclass(slots=True)
class Page:
    """A page's lines for the search of defects."""

    ids: list[str]
    outlines: list[np.ndarray]
    baselines: list[np.ndarray]
    manual: np.ndarray
    used: np.ndarray  # has a text or a pairing
    width: float

    def boxes(self) -> np.ndarray:
        return np.array([[*o.min(axis=0), *o.max(axis=0)] if len(o) else [0.0] * 4 for o in self.outlines]).reshape(-1, 4)


def bands(boxes: np.ndarray, width: float) -> np.ndarray:
    """x ranges of the columns: runs of slices that many lines of text width cover, drawn in to the lines that fill them."""
    if width <= 0 or not len(boxes):
        return np.zeros((0, 2))
    span = boxes[boxes[:, 2] - boxes[:, 0] >= RUNNING * width][:, [0, 2]]
    if not len(span):
        return np.zeros((0, 2))
    step = width / SLICES
    edge = np.clip((span / step).astype(int), 0, SLICES - 1)
    cover = np.cumsum(np.bincount(edge[:, 0], minlength=SLICES + 1) - np.bincount(edge[:, 1] + 1, minlength=SLICES + 1))[:SLICES]
    full = np.concatenate([[False], cover >= COVERED * cover.max(), [False]])
    out = []
    for a, b in zip(np.flatnonzero(~full[:-1] & full[1:]), np.flatnonzero(full[:-1] & ~full[1:]), strict=True):
        low, high = a * step, b * step
        inside = span[(span[:, 0] >= low - step) & (span[:, 1] <= high + step)]
        out.append((inside[:, 0].min(), inside[:, 1].max()) if len(inside) else (low, high))
    return np.array([x for x in out if x[1] - x[0] >= RUNNING * width]).reshape(-1, 2)


def band_of(boxes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The column that holds at least half of each line, -1 for none."""
    if not len(columns):
        return np.full(len(boxes), -1)
    shared = np.maximum(0, np.minimum(boxes[:, None, 2], columns[None, :, 1]) - np.maximum(boxes[:, None, 0], columns[None, :, 0]))
    best = shared.argmax(axis=1)
    held = shared[np.arange(len(boxes)), best]
    return np.where((held > 0) & (held >= 0.5 * (boxes[:, 2] - boxes[:, 0])), best, -1)


def spacing_of(baselines: list[np.ndarray], band: np.ndarray) -> float:
    """Median distance from one line to the next within a column; 0 without any."""
    at = np.array([b[:, 1].mean() if len(b) > 1 else np.nan for b in baselines])
    gaps = [np.diff(np.sort(at[(band == k) & ~np.isnan(at)])) for k in range(int(band.max(initial=-1)) + 1)]
    gaps = np.concatenate(gaps) if gaps else np.zeros(0)
    return float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 0.0


def defects(page: Page) -> list[tuple[str, str, str | None, float]]:
    """``(finding, line, other line, value)``: suspects (value: corners), spanning lines (cuts), fragments (gap of the baselines),
    overlaps and duplicates (shared part of the smaller outline).  Lines drawn by hand are never found."""
    boxes = page.boxes()
    width, height = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    corners = np.array([len(o) for o in page.outlines], dtype=int)
    whole = corners >= 3
    columns = bands(boxes[whole], page.width)
    band = band_of(boxes, columns)
    typical = float(np.median(height[whole])) if whole.any() else 0.0
    spacing = spacing_of([b if w else b[:0] for b, w in zip(page.baselines, whole, strict=True)], band)
    out: list[tuple[str, str, str | None, float]] = []

    speck = (corners <= FEW_CORNERS) & (height < SQUAT * typical)
    for i in np.flatnonzero(whole & ~page.manual & ~page.used & (width < THIN * page.width) & (speck | ((band < 0) & (len(columns) > 0)))):
        out.append(("suspect", page.ids[i], None, float(corners[i])))

    for i in np.flatnonzero(whole & ~page.manual) if len(columns) > 1 else ():
        reach = _share(columns[:, 0], columns[:, 1], boxes[i, 0], boxes[i, 2])
        over = columns[np.maximum(0, reach) >= REACHES * np.minimum(columns[:, 1] - columns[:, 0], width[i])]
        if len(over) < 2:
            continue
        cuts = [None, *((over[:-1, 1] + over[1:, 0]) / 2).tolist(), None]
        if all(len(cut_between(page.outlines[i], a, b)) >= 3 and len(cut_baseline(page.baselines[i], a, b)) >= 2 for a, b in zip(cuts, cuts[1:], strict=False)):
            out.append(("spanning", page.ids[i], None, float(len(cuts) - 2)))

    fit = np.flatnonzero(whole & ~page.manual & np.array([len(b) >= 2 for b in page.baselines], dtype=bool))
    claimed: set[int] = set()
    for k, i in enumerate(fit) if spacing > 0 else ():
        rest = fit[k + 1 :]
        gap = np.maximum(boxes[i, 0], boxes[rest, 0]) - np.minimum(boxes[i, 2], boxes[rest, 2])
        small, large = np.minimum(width[i], width[rest]), np.maximum(width[i], width[rest])
        for j in rest[(band[rest] == band[i]) & (gap <= NEAR * np.maximum(height[i], height[rest])) & (small <= LOPSIDED * large)]:
            piece, other = (j, i) if width[i] >= width[j] else (i, j)
            if {i, j} & claimed or page.used[piece]:
                continue
            apart = baseline_gap(page.baselines[i], page.baselines[j])
            if apart < COLLINEAR * spacing:
                claimed.add(piece)
                out.append(("fragment", page.ids[piece], page.ids[other], round(apart, 3)))

    sizes = np.array([area(o) for o in page.outlines])
    order = fit[np.argsort(boxes[fit, 1], kind="stable")]
    for k, i in enumerate(order):
        rest = order[k + 1 :]
        rest = rest[: np.searchsorted(boxes[rest, 1], boxes[i, 3], side="left")]
        for j in rest[(boxes[rest, 0] < boxes[i, 2]) & (boxes[rest, 2] > boxes[i, 0])]:
            if min(sizes[i], sizes[j]) <= 0:
                continue
            ratio = shared_by_columns(page.outlines[i], page.outlines[j]) / min(sizes[i], sizes[j])
            upper, lower = sorted((i, j), key=lambda x: (page.baselines[x][:, 1].mean(), x))
            if ratio >= DUPLICATE:
                out.append(("duplicate", page.ids[upper], page.ids[lower], round(ratio, 3)))
            elif ratio >= DEFECT:
                at = midline(page, upper, lower)
                if len(cut(page.outlines[upper], at, 1, below=True)) >= 3 and len(cut(page.outlines[lower], at, 1, below=False)) >= 3:
                    out.append(("overlap", page.ids[upper], page.ids[lower], round(ratio, 3)))
    return out


def midline(page: Page, upper: int, lower: int) -> float:
    """Height midway between two baselines over the x range of both outlines."""
    b = page.boxes()
    low, high = max(b[upper, 0], b[lower, 0]), min(b[upper, 2], b[lower, 2])
    xs = np.linspace(low, high, 3) if high > low else np.array([(low + high) / 2])
    return float(np.mean([heights_at(page.baselines[k], xs) for k in (upper, lower)]))


def merged_line(outlines: list[np.ndarray], baselines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Outline and baseline of lines merged into one."""
    return merged_outline(outlines), merged_baseline(baselines)
