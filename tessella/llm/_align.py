"""Banded alignment of word sequences."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int, quick: int = 40) -> int | None:
    """Edits (insert, delete, replace) between two sequences, or None if more than ``limit``.

    Only diagonals within ``limit`` of the main one are looked at. The first ``quick`` edits are counted along
    furthest-reaching points of the diagonals, more of them row by row, in a band that is doubled until it holds them.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    same = min(n, m)
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    tail = int(differ[0]) if len(differ) else same
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= limit else None
    breaks: dict[int, list[int]] = {}

    def slide(k: int, i: int) -> int:
        """The first i' >= i on diagonal k where the sequences differ or one ends."""
        if k not in breaks:
            lo, hi = max(0, -k), min(n, m - k)
            breaks[k] = [*(np.flatnonzero(a[lo:hi] != b[lo + k : hi + k]) + lo).tolist(), hi] if hi > lo else [max(lo, hi)]
        return max(i, breaks[k][min(bisect_left(breaks[k], i), len(breaks[k]) - 1)])

    reach = {0: slide(0, 0)}
    for d in range(min(limit, quick) + 1):
        if d:
            new = {}
            for k in range(max(-d, -n), min(d, m) + 1):
                i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
                if i >= 0 and i <= n and i + k <= m:
                    new[k] = slide(k, i) if i < n and i + k < m and i + k >= 0 else i
                elif i > n or i + k > m:
                    new[k] = min(n, m - k)
            reach = new
        if reach.get(m - n, -1) >= n:
            return d
    band = max(2 * quick, abs(n - m), 1)
    while band < limit:
        if (found := _rows(a, b, band)) is not None:
            return found
        band *= 2
    return _rows(a, b, limit)


def _rows(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    n, m = len(a), len(b)
    width = 2 * limit + 1
    ramp, far = np.arange(width), np.int64(1 << 40)
    padded = np.zeros(m + 2 * width + 2, b.dtype)
    padded[width : width + m] = b
    inside = np.zeros(m + 2 * width + 2, bool)
    inside[width : width + m] = True
    last = np.where((ramp >= limit) & (ramp - limit <= m), ramp - limit, far)
    for i in range(1, n + 1):
        at = i - limit - 1 + width  # padded place of b[j - 1] for the band's first j
        cost = np.where(inside[at : at + width], (padded[at : at + width] != a[i - 1]).astype(np.int64), far)
        now = last + cost
        now[:-1] = np.minimum(now[:-1], last[1:] + 1)
        if i <= limit:
            now[limit - i] = i
            now[: limit - i] = far
        over = m - i + limit + 1
        if over < width:
            now[max(0, over) :] = far
        now = np.minimum.accumulate(now - ramp) + ramp
        if over < width:
            now[max(0, over) :] = far
        if now.min() > limit:
            return None
        last = now
    at = m - n + limit
    return int(last[at]) if 0 <= at < width and last[at] <= limit else None


def local_alignment(a: np.ndarray, b: np.ndarray, diagonal: int, width: int) -> tuple[int, int, int, int, int]:
    """Best local alignment of ``a`` to ``b`` within ``width`` diagonals of ``diagonal`` (place in b minus place in a).

    A match counts 1, an edit -1. Gives (matched words, first in a, end in a, first in b, end in b).
    """
    n, m, band = len(a), len(b), 2 * width + 1
    score = np.zeros(band, np.int64)
    info = np.zeros((band, 3), np.int64)  # matches, first in a, first in b
    best = (0, 0, 0, 0, 0, 0)
    ramp = np.arange(band)
    for i in range(n):
        j = i + diagonal - width + ramp
        ok = (j >= 0) & (j < m)
        if not ok.any():
            continue
        match = np.zeros(band, bool)
        match[ok] = b[j[ok]] == a[i]
        fresh = score <= 0
        step = np.where(fresh, 0, score) + np.where(match, 1, -1)
        begun = info.copy()
        begun[fresh] = np.stack([np.zeros(fresh.sum(), np.int64), np.full(fresh.sum(), i), j[fresh]], 1)
        begun[:, 0] += match
        up = np.append(score[1:], -(1 << 30)) - 1
        better = up > step
        step[better] = up[better]
        begun[better] = np.append(info[1:], info[-1:], 0)[better]
        step[~ok] = -1
        lead = np.maximum.accumulate(step + ramp)
        source = np.maximum.accumulate(np.where(step + ramp == lead, ramp, -1))
        score, info = lead - ramp, begun[source]
        score[~ok] = 0
        score = np.maximum(score, 0)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(info[top, 0]), int(info[top, 1]), i + 1, int(info[top, 2]), int(j[top]) + 1)
    return best[1:]
