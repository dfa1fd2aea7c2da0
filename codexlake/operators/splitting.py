"""Split allocation on group tables: few rows, one for each group, never the records themselves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Groups up to which all assignments are tried.
EXHAUSTIVE = 12


def allocate(total: int, fractions: Sequence[float]) -> list[int]:
    """Counts by largest remainder; no part is empty if there are enough items."""
    exact = [total * f for f in fractions]
    counts = [int(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: (counts[i] - exact[i], i))[: total - sum(counts)]:
        counts[i] += 1
    for i, c in enumerate(counts):
        if c == 0 and total >= len(counts):
            counts[int(np.argmax(counts))] -= 1
            counts[i] = 1
    return counts


def exhaustive(sizes: Sequence[int], fractions: Sequence[float]) -> list[int]:
    """Split of each group with the least deviation from the fractions, all assignments tried; ties: first in order."""
    n, k = len(sizes), len(fractions)
    if n > EXHAUSTIVE:
        raise ValueError(f"more than {EXHAUSTIVE} groups")
    choice = np.arange(k**n)
    digits = np.stack([choice // k ** (n - 1 - i) % k for i in range(n)], axis=1) if n else np.zeros((1, 0), dtype=int)
    filled = np.stack([(digits == s) @ np.asarray(sizes, dtype=np.int64) for s in range(k)], axis=1)
    deviation = np.abs(filled - np.asarray(fractions) * sum(sizes)).sum(axis=1)
    # A split may be empty only if there are fewer groups than splits.
    if n >= k:
        deviation = np.where((filled > 0).all(axis=1), deviation, np.inf)
    return digits[int(np.argmin(np.round(deviation, 9)))].tolist()


def greedy(sizes: Sequence[int], bounds: Sequence[float]) -> list[int]:
    """Groups in the given order fill the splits one after the other.

    A split is full once it holds a group and the running total has reached its cumulative bound; as many groups are
    held back as there are splits still to come, so none of them stays empty.
    """
    total, done = sum(sizes), np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else []
    out: list[int] = []
    split, used = 0, False
    for i, before in enumerate(done):
        while split < len(bounds) and ((used and before >= bounds[split] * total) or len(sizes) - i <= len(bounds) - split):
            split, used = split + 1, False
        out.append(split)
        used = True
    return out


def merge_undersized(groups: dict[str, int], least: int) -> dict[str, str]:
    """Where each group goes: those with fewer than ``least`` members join the largest (ties: first by name), others stay."""
    if not groups:
        return {}
    largest = min(groups, key=lambda g: (-groups[g], g))
    return {g: g if g == largest or n >= least else largest for g, n in groups.items()}
