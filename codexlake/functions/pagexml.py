"""PAGE XML read as a page: reading order of its lines, and what would fail a reader of it."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np

# Fixed value: the namespace that readers expect.
NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
# Tags of ``custom`` that readers act upon.
READER_TAGS = frozenset({"structure", "readingOrder", "split"})
_INDEX = re.compile(r"readingOrder\s*\{[^}]*index:\s*(\d+)")


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _below(element: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in element if _name(c) == name]


def points_of(element: ET.Element | None) -> np.ndarray:
    """The points of an element that are pairs of numbers."""
    out = []
    for pair in (element.get("points") or "").split() if element is not None else ():
        parts = pair.split(",")
        try:
            out.append((float(parts[0]), float(parts[1])))
        except (ValueError, IndexError):
            continue
    return np.array(out, dtype=float).reshape(-1, 2)


def _first(element: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        found = _below(element, name)
        if not found:
            return None
        element = found[0]
    return element


def _page(text: str) -> ET.Element | None:
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return None
    return next((e for e in root.iter() if _name(e) == "Page"), None)


def page_lines(text: str | None, by_place: bool = False) -> list[tuple[str, str, str, int]] | None:
    """``(region, line, text, corners)`` of the lines that have a text and an outline of three points; None for no page.

    Regions come in the page's reading order, those it leaves out after them by id; lines by the index in ``custom``, else
    as they stand.  ``by_place``: all lines of the page by the least height and x of their outlines instead.
    """
    page = _page(text) if text is not None else None
    if page is None:
        return None
    regions = {e.get("id") or f"region_{i}": e for i, e in enumerate(_below(page, "TextRegion"))}
    named = [r.get("regionRef") for e in page if _name(e) == "ReadingOrder" for r in e.iter() if _name(r) == "RegionRefIndexed"]
    order = list(dict.fromkeys([r for r in named if r in regions] + sorted(regions)))
    out: list[tuple[tuple, tuple[str, str, str, int]]] = []
    for region in order:
        for at, line in enumerate(_below(regions[region], "TextLine")):
            words = _first(line, "TextEquiv", "Unicode")
            said = (words.text or "").strip() if words is not None else ""
            corners = points_of(_first(line, "Coords"))
            if said and len(corners) >= 3:
                given = _INDEX.search(line.get("custom") or "")
                key = (*corners.min(axis=0)[::-1],) if by_place else (order.index(region), int(given[1]) if given else at)
                out.append((key, (region, line.get("id") or f"line_{len(out)}", said, len(corners))))
    return [row for _, row in sorted(out, key=lambda x: x[0])]


def _custom_problems(element: ET.Element, label: str) -> list[tuple[str, str]]:
    parts = [p for p in (element.get("custom") or "").split("}") if p.strip()]
    if any("{" not in p for p in parts):
        return [("custom is no list of tags", label)]
    return [("custom has a tag that readers act upon", label) for p in parts if p.partition("{")[0].strip() in READER_TAGS]


def _broken(element: ET.Element | None) -> bool:
    """Whether an element's points aren't pairs of whole numbers."""
    return element is not None and any(not re.fullmatch(r"[+-]?\d+", c) for pair in (element.get("points") or "").split() for c in pair.split(","))


def _line_problems(line: ET.Element) -> list[tuple[str, str]]:
    label = line.get("id") or ""
    coords, base = _first(line, "Coords"), _first(line, "Baseline")
    outline, points = points_of(coords), points_of(base)
    checks = [
        ("coordinate is no whole number", _broken(coords) or _broken(base)),
        ("outline has fewer than 3 points", len(outline) < 3),
        ("no baseline", base is None),
        ("baseline has fewer than 2 points", base is not None and len(points) < 2),
        ("baseline doesn't run from left to right", len(points) > 1 and bool((np.diff(points[:, 0]) <= 0).any())),
        ("baseline leaves its outline", len(points) > 1 and len(outline) > 0 and bool(((points < outline.min(axis=0) - 0.5) | (points > outline.max(axis=0) + 0.5)).any())),
        ("no text element", _first(line, "TextEquiv", "Unicode") is None),
    ]
    return _custom_problems(line, label) + [(what, label) for what, wrong in checks if wrong]


def page_problems(text: str | None) -> list[tuple[str, str]] | None:
    """``(problem, element)`` of a PAGE XML document, all that a strict reader would stumble over; None for null."""
    if text is None:
        return None
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return [("not well-formed", "")]
    if root.tag != f"{{{NAMESPACE}}}PcGts":
        return [("root is no PcGts of the expected namespace", root.tag)]
    page = _first(root, "Page")
    if page is None:
        return [("no page", "")]
    out = [] if page.get("imageFilename") else [("page names no image", "")]
    regions = _below(page, "TextRegion")
    orders = _below(page, "ReadingOrder")
    if orders:
        ids, named = {r.get("id") or "" for r in regions}, [r.get("regionRef") or "" for r in orders[0].iter() if _name(r) == "RegionRefIndexed"]
        out += [("reading order names no region", n) for n in named if n not in ids] + [("reading order leaves a region out", i) for i in sorted(ids - set(named))]
    for region in regions:
        label, coords = region.get("id") or "", _first(region, "Coords")
        out += _custom_problems(region, label)
        out += [("region has no outline", label)] if coords is None else [("coordinate is no whole number", label)] * _broken(coords)
        for line in _below(region, "TextLine"):
            out += _line_problems(line)
    return out
