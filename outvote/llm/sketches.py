"""SuperMinHash signatures of many sets at once."""

import numpy as np

from .kernels import draw

_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64(32)


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int = 128) -> np.ndarray:
    """``n_sets`` x ``m`` values; two sets agree in a slot with probability of their Jaccard similarity.

    Each element deals the ranks 0, 1, ... to the slots by its own random permutation and
    offers ``rank + fraction``; a slot keeps the least offer. An offer of rank j never beats one of
    a lower rank, so a set is finished as soon as every slot has an offer: round j handles only the
    sets that still have an open slot. The permutation is drawn step by step (Fisher-Yates), by
    tracing swaps in the first rounds and by a table for the few elements left after them.
    ``owner`` is the set of each element, ``m`` below 32768; an empty set keeps the highest value everywhere.
    """
    sig = np.full(n_sets * m, _EMPTY, np.uint64)
    swaps: list[np.ndarray] = []
    table = None
    for j in range(m):
        noise = draw(elements, 2 * j)
        k = ((noise >> _LOW) * np.uint64(m - j) >> _LOW).astype(np.int16) + np.int16(j)
        if j < 8:
            slot = k
            for i in range(j - 1, -1, -1):
                slot = np.where(slot == swaps[i], np.int16(i), np.where(slot == i, swaps[i], slot))
            swaps.append(k)
        else:
            rows = np.arange(len(elements))
            if table is None:
                table = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                for i, old in enumerate(swaps):
                    table[rows, i], table[rows, old] = table[rows, old], table[rows, i].copy()
            slot = table[rows, k]
            table[rows, k] = table[rows, j]
            table[rows, j] = slot
        offer = (draw(elements, 2 * j + 1) >> np.uint64(8)) | np.uint64(j << 56)
        np.minimum.at(sig, owner * m + slot, offer)
        unfinished = sig.reshape(n_sets, m).max(axis=1) == _EMPTY
        live = unfinished[owner]
        if not live.any():
            break
        if not live.all():
            elements, owner = elements[live], owner[live]
            swaps = [s[live] for s in swaps]
            table = table[live] if table is not None else None
    return sig.reshape(n_sets, m)


def bands(sig: np.ndarray, n_bands: int) -> np.ndarray:
    """One 64-bit key per set and band of consecutive slots."""
    rows = sig.shape[1] // n_bands
    part = sig[:, : n_bands * rows].reshape(len(sig), n_bands, rows)
    key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(rows):
        key = draw(key ^ part[:, :, r], r)
    return key
