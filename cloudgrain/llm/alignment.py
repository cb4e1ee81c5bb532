"""Banded word alignment: is the edit distance of two word sequences within a limit?"""

from __future__ import annotations

import numpy as np

_FAR = -(1 << 40)
_NARROW = 8  # edits up to which single steps are fastest
_SHORT = 4096  # words up to which columns of bits are faster than whole diagonals
_BINS = 2048  # of the first, coarse count of common words


def similarity_at_least(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether ``1 - edits / longer length`` is at least ``least``; edits insert, delete or replace a word."""
    longest = max(len(a), len(b))
    return within(a, b, int((1 - least) * longest + 1e-9))


def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether at most ``limit`` edits turn ``a`` into ``b``. Only the diagonals up to ``limit`` are walked."""
    if abs(len(a) - len(b)) > limit:
        return False
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if differ.any() else n
    a, b, n = a[at:], b[at:], n - at
    differ = a[len(a) - n:][::-1] != b[len(b) - n:][::-1]
    back = int(differ.argmax()) if differ.any() else n
    a, b = a[:len(a) - back], b[:len(b) - back]
    if max(len(a), len(b)) <= limit:
        return True
    # Every word that the other bag lacks costs an edit. Counted by bins first, without a sort: words of one bin
    # seem equal, so the coarse count is never too low.
    bins = np.minimum(np.bincount(a & (_BINS - 1), minlength=_BINS), np.bincount(b & (_BINS - 1), minlength=_BINS))
    if max(len(a), len(b)) - bins.sum() > limit:
        return False
    _, ids = np.unique(np.concatenate((a, b)), return_inverse=True)
    kinds = int(ids.max()) + 1
    common = np.minimum(np.bincount(ids[:len(a)], minlength=kinds), np.bincount(ids[len(a):], minlength=kinds)).sum()
    if max(len(a), len(b)) - common > limit:
        return False
    x, y = a.tolist(), b.tolist()
    if _walk(x, y, min(limit, _NARROW)):
        return True
    if limit <= _NARROW:
        return False
    return _columns(x, y, limit) if max(len(a), len(b)) <= _SHORT else _walk_wide(a, b, limit)


def _columns(a: list, b: list, limit: int) -> bool:
    """Whether at most ``limit`` edits turn ``a`` into ``b``: a column of the edit table per word of ``b``, its steps up and down as bits (Myers, 1999)."""
    if not a:
        return len(b) <= limit
    at: dict[int, int] = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) >> 1
    up, down, edits = every, 0, len(a)
    for left, word in enumerate(b, 1 - len(b)):
        same = at.get(word, 0)
        across = ((same & up) + up ^ up) | same
        more, fewer = down | every & ~(across | up), up & across
        edits += bool(more & last) - bool(fewer & last)
        if edits + left > limit:  # a column changes the last row by one at most
            return False
        more, fewer = (more << 1 | 1) & every, fewer << 1 & every
        up, down = fewer | every & ~(same | down | more), more & (same | down)
    return edits <= limit


def _walk(a: list, b: list, limit: int) -> bool:
    """Furthest row on each diagonal after 0, 1, 2 ... edits."""
    n, m = len(a), len(b)
    goal = m - n
    reach = [_FAR] * (2 * limit + 5)
    mid = limit + 2
    for d in range(limit + 1):
        new = reach[:]
        for k in range(-d, d + 1):
            c = mid + k
            i = max(reach[c] + 1, reach[c - 1], reach[c + 1] + 1) if d else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            new[c] = i
            if k == goal and i >= n:
                return True
        reach = new
    return False


def _walk_wide(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """The same for wide bands, all diagonals of a step at once."""
    n, m = len(a), len(b)
    mid = limit + 2
    reach = np.full(2 * limit + 5, _FAR, np.int64)
    for d in range(limit + 1):
        k = np.arange(-d, d + 1)
        c = mid + k
        i = np.maximum(np.maximum(reach[c] + 1, reach[c - 1]), reach[c + 1] + 1) if d else np.zeros(1, np.int64)
        i = np.minimum(i, np.minimum(n, m - k))
        live = np.flatnonzero((i >= 0) & (i + k >= 0))
        i[(i < 0) | (i + k < 0)] = _FAR
        steps = 0
        while len(live):
            if len(live) <= 2 or steps > 8:
                for x in live:
                    i[x] = _run(a, b, int(i[x]), int(k[x]))
                break
            x, y = i[live], i[live] + k[live]
            live = live[(x < n) & (y < m)]
            live = live[a[i[live]] == b[i[live] + k[live]]]
            i[live] += 1
            steps += 1
        reach[c] = i
        if abs(m - n) <= d and i[m - n + d] >= n:
            return True
    return False


def _run(a: np.ndarray, b: np.ndarray, i: int, k: int) -> int:
    size = 16
    while (room := min(len(a) - i, len(b) - i - k, size)) > 0:
        differ = a[i:i + room] != b[i + k:i + k + room]
        if differ.any():
            return i + int(differ.argmax())
        i, size = i + room, size * 2
    return i
