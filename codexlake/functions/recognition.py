"""Outputs of recognisers: label runs, decoding with confidences, voting of several recognisers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexlake.functions.metrics import align


def _runs(labels: Sequence[int] | None, scores: Sequence[float] | None) -> list[tuple[int, int, int, float, int]] | None:
    if labels is None or scores is None:
        return None
    label, score = np.asarray(labels), np.asarray(scores, dtype=float)
    if not len(label):
        return []
    starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    return [(int(label[a]), int(a), int(b) - 1, float(score[a:b].mean()), int(a + score[a:b].argmin())) for a, b in zip(starts, [*starts[1:], len(label)], strict=True)]


def label_runs(labels: str | Column, scores: str | Column) -> Column:
    """Runs of equal labels as ``array<struct<label, start, stop, mean, weakest>>``, with the mean score and the weakest frame.

    Frames count from 0, ``stop`` is inclusive; time and space are in proportion to the frames; null stays null.
    """
    names = ("label", "start", "stop", "mean", "weakest")

    def runs(left: pd.Series, right: pd.Series) -> pd.Series:
        found = [_runs(a, b) for a, b in zip(left, right, strict=True)]
        return pd.Series([None if f is None else [dict(zip(names, x, strict=True)) for x in f] for f in found], dtype=object)

    return F.pandas_udf(runs, "array<struct<label:bigint,start:int,stop:int,mean:double,weakest:int>>")(labels, scores)


def decoded(labels: str | Column, scores: str | Column, charset: Sequence[str], blank: int = 0) -> Column:
    """Greedy decoding: ``struct<text, confidences, mean, least>`` of the runs that aren't blank; an empty text has no mean.

    A label outside the character set is an error.
    """

    def texts(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        kept = [[r for r in found if r[0] != blank] if (found := _runs(a, b)) is not None else None for a, b in zip(left, right, strict=True)]
        if any(not 1 <= r[0] <= len(charset) for k in kept if k for r in k):
            raise ValueError("label outside the character set")
        own = [[r[3] for r in k] if k is not None else None for k in kept]
        text = ["".join(charset[r[0] - 1] for r in k) if k is not None else None for k in kept]
        return pd.DataFrame({"text": text, "confidences": own, "mean": [float(np.mean(c)) if c else None for c in own], "least": [min(c) if c else None for c in own]})

    return F.pandas_udf(texts, "text string, confidences array<double>, mean double, least double")(labels, scores)


def best_rivals(scores: str | Column, k: int = 3) -> Column:
    """The ``k`` best classes of a frame as ``array<struct<score, label>>``, best first, ties to the lesser label."""
    column = F.col(scores) if isinstance(scores, str) else scores
    ranked = F.array_sort(F.transform(column, lambda s, i: F.struct((-s).alias("n"), i.alias("label"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct((-r["n"]).alias("score"), r["label"].alias("label")))


def alternatives(frames: np.ndarray, charset: Sequence[str], threshold: float = 0.05, blank: int = 0) -> list[dict[str, float]]:
    """For each decoded character the classes above ``threshold`` at its best frame, with their probabilities."""
    p = np.asarray(frames, dtype=float)
    if not len(p):
        return []
    best = p.argmax(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    out = []
    for a, b in zip(starts, [*starts[1:], len(best)], strict=True):
        if best[a] != blank:
            top = p[a + int(p[a:b, best[a]].argmax())]
            out.append({charset[k - 1]: float(top[k]) for k in np.flatnonzero(top >= threshold) if k != blank})
    return out


def aligned_columns(texts: Sequence[str]) -> list[list[str]]:
    """Texts side by side: for each place of the first text, and each gap of it that another fills, a character of every text ('' for none).

    All texts are aligned with the first one by cheapest edits; what stands between two of its places shares columns by order.
    """
    first = texts[0]
    slots: list[list[list[str]]] = [[[] for _ in texts] for _ in range(2 * len(first) + 1)]
    for v, text in enumerate(texts):
        at = 0
        for op, _, b in align(first, text):
            if op == "ins":
                slots[2 * at][v].append(b)
            else:
                if op != "del":
                    slots[2 * at + 1][v].append(b)
                at += 1
    out = []
    for slot in slots:
        for k in range(max(len(x) for x in slot)):
            out.append([x[k] if k < len(x) else "" for x in slot])
    return out


def majority_text(texts: Sequence[str]) -> str:
    """The character most texts have at each place; ties go to the earlier text, a gap that most share is left out.

    The texts vote in the order of how near their letter pairs come to the median of all, so the most typical one leads.
    """
    if not texts:
        return ""
    pairs = [Counter(t[i : i + 2] for i in range(len(t))) for t in texts]
    keys = sorted(set().union(*pairs))
    counts = np.array([[c[k] for k in keys] for c in pairs], dtype=float).reshape(len(texts), -1)
    distance = np.abs(counts - np.median(counts, axis=0)).sum(axis=1) if len(keys) else np.zeros(len(texts))
    order = [texts[i] for i in np.argsort(distance, kind="stable")]
    out = []
    for column in aligned_columns(order):
        votes = Counter(column)
        most = max(votes.values())
        out.append(next(c for c in column if votes[c] == most))
    return "".join(out)


def confident_text(texts: Sequence[str], confidences: Sequence[Sequence[float]]) -> tuple[str, float]:
    """The character with the greatest mean confidence at each place, over the texts that agree on whether there is one; and the mean.

    A place that most texts leave empty is left out (ties keep it).
    """
    if not texts:
        return "", 0.0
    at = [0] * len(texts)
    out, held = [], []
    for column in aligned_columns(texts):
        scores: dict[str, float] = {}
        voters = [v for v, c in enumerate(column) if c]
        for v in voters:
            scores[column[v]] = scores.get(column[v], 0.0) + confidences[v][at[v]] / len(voters)
            at[v] += 1
        if 2 * len(voters) >= len(texts):
            best = max(scores, key=lambda c: (scores[c], -column.index(c)))
            out.append(best)
            held.append(scores[best])
    return "".join(out), float(np.mean(held)) if held else 0.0


def voted(texts: str | Column, confidences: str | Column | None = None) -> Column:
    """``majority_text`` of an array of texts, or ``confident_text`` where confidences are given; null for null and empty arrays."""

    def majority(values: pd.Series) -> pd.Series:
        return values.map(lambda v: majority_text([t for t in v if t is not None]) if v is not None and len(v) else None)

    def confident(values: pd.Series, scores: pd.Series) -> pd.Series:
        return pd.Series([confident_text(list(v), [list(x) for x in s])[0] if v is not None and len(v) else None for v, s in zip(values, scores, strict=True)])

    if confidences is None:
        return F.pandas_udf(majority, "string")(texts)
    return F.pandas_udf(confident, "string")(texts, confidences)
