"""Text metrics: rates with their empty conventions, alignments, collapsed label sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def error_rate(edits: Column, length: Column, digits: int = 4) -> Column:
    """Edits over reference length; 0.0 where there is no reference (corpus convention)."""
    return F.when(length > 0, F.round(edits / length, digits)).otherwise(F.lit(0.0))


def pair_cer(reference: str, prediction: str) -> Column:
    """CER of one pair: both empty 0, only the reference empty 1."""
    r, p = F.coalesce(reference, F.lit("")), F.coalesce(prediction, F.lit(""))
    return F.when(F.length(r) > 0, F.levenshtein(r, p) / F.length(r)).otherwise(F.when(F.length(p) > 0, 1.0).otherwise(0.0))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of any items."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def align(a: str, b: str) -> list[tuple[str, str, str]]:
    """Edit operations ``(op, a, b)`` of a cheapest alignment; ops ``eq``, ``sub``, ``del``, ``ins``.

    Among equal costs the name of the operation decides, in alphabetical order.
    """
    cost = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    cost[:, 0], cost[0, :] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b], dtype=np.int64)
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        free = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (codes != ord(x)))
        cost[i, 1:] = (np.minimum.accumulate(np.concatenate([[i], free]) - steps) + steps)[1:]
    out, i, j = [], len(a), len(b)
    while i or j:
        options = []
        if i and j:
            same = a[i - 1] == b[j - 1]
            options.append((cost[i - 1, j - 1] + (not same), "eq" if same else "sub"))
        if i:
            options.append((cost[i - 1, j] + 1, "del"))
        if j:
            options.append((cost[i, j - 1] + 1, "ins"))
        op = min(o for o in options if o[0] == cost[i, j])[1]
        out.append((op, a[i - 1] if op != "ins" else "", b[j - 1] if op != "del" else ""))
        i -= op != "ins"
        j -= op != "del"
    return out[::-1]


def edit_ops(reference: str, prediction: str) -> Column:
    """Operations other than equality as ``array<struct<op, a, b>>``; null if either text is null."""

    def ops(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip("oab", x, strict=True)) for x in align(a, b) if x[0] != "eq"] if a is not None and b is not None else None for a, b in zip(left, right, strict=True)])

    return F.pandas_udf(ops, "array<struct<o:string,a:string,b:string>>")(reference, prediction)


def sequence_distance(a: Sequence, b: Sequence) -> int:
    """``edit_distance`` with a whole row of the table in the bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, out = full, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        across = ((same & more) + more ^ more) | same
        up, down = less | full & ~(across | more), more & across
        out += bool(up & top) - bool(down & top)
        up, down = up << 1 & full | 1, down << 1 & full
        stay = same | less
        more, less = down | full & ~(stay | up), up & stay
    return out


def word_distance(reference: str, prediction: str) -> Column:
    """Levenshtein distance over white-space separated words; null if either text is null."""

    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([sequence_distance(a.split(), b.split()) if a is not None and b is not None else None for a, b in zip(left, right, strict=True)], dtype="Int64")

    return F.pandas_udf(distance, "bigint")(reference, prediction)


def collapse(labels: Column, blank: int = 0) -> Column:
    """CTC decoding of a label array: repeats first, then blanks are dropped."""
    kept = F.filter(labels, lambda x, i: (i == 0) | (x != F.get(labels, i - 1)))
    return F.filter(kept, lambda x: x != blank)
