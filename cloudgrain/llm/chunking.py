"""Content-defined chunk borders by a normalised gear hash, for many texts at once.

The gear hash of a place sums a random value of each of the last 16 bytes, shifted
by their distance: ``h = (h << 2) + G[byte]`` in 32 bits. Its top bits choose the
borders, so a border depends on 16 bytes only. Borders are normalised: up to the
normal size a strict mask must be zero, beyond it a loose one, and a chunk ends at
the latest at the maximum size.
"""

from __future__ import annotations

import numpy as np

WINDOW = 16
_NEVER = 1 << 60
_GEAR = np.random.default_rng(20240602).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(a: np.ndarray) -> np.ndarray:
    """Gear hash at every byte of ``a`` (uint8), by doubling the window."""
    h = _GEAR[a]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(2 * width)
        h, width = wider, 2 * width
    return h


def cut_points(texts: list[bytes], least: int, normal: int, most: int, whole_characters: bool = False) -> list[np.ndarray]:
    """Ends of the chunks of each text (the last end is its length; none for an empty text).

    With ``whole_characters`` no border falls inside a UTF-8 character.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in texts]
    a = np.frombuffer(b"".join(texts), np.uint8)
    top = np.concatenate(([0], np.cumsum(sizes)))
    h = gear_hashes(a)
    bits = max(1, int(round(np.log2(max(2, normal - least)))))
    hard, soft = h >> np.uint32(32 - bits - 1) == 0, h >> np.uint32(32 - max(1, bits - 2)) == 0
    # A border lies behind its byte; windows that reach into the text before are no borders within the first bytes.
    start_ok = np.ones(len(a) + 1, bool)
    if whole_characters:
        start_ok[:-1] = (a & 0xC0) != 0x80
    strict = np.append(np.flatnonzero(hard & start_ok[1:]) + 1, _NEVER)
    loose = np.append(np.flatnonzero(soft & start_ok[1:]) + 1, _NEVER)
    at, end = top[:-1][sizes > 0].copy(), top[1:][sizes > 0]
    all_cuts = []
    while len(at):
        first = strict[np.searchsorted(strict, at + least)]
        later = loose[np.searchsorted(loose, at + normal)]
        cut = np.where(first < at + normal, first, np.minimum(later, at + most))
        cut = np.minimum(cut, end)
        if whole_characters:
            while (inside := ~start_ok[cut]).any():
                cut[inside] -= 1
        all_cuts.append(cut)
        going = cut < end
        at, end = cut[going], end[going]
    cuts = np.sort(np.concatenate(all_cuts))
    split = np.searchsorted(cuts, top, side="right")
    return [cuts[split[i]:split[i + 1]] - top[i] for i in range(len(texts))]
