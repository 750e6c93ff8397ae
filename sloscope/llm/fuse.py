"""Static three-wise binary fuse filter over 64-bit keys (Graf & Lemire, 2022), in NumPy.

Construction peels the whole frontier of degree-one slots in each round, so a
round is a handful of vector operations; keys peeled in one round never touch
each other's own slots, which lets the reverse assignment run vectorised too.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QIII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def _slots(h: np.ndarray, seg_len: int, seg_count: int) -> np.ndarray:
    """The three slots of each key: one in each of three neighbouring segments."""
    span = np.uint64(seg_len * seg_count)
    first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
    mask = np.uint64(seg_len - 1)
    second = first + np.uint64(seg_len)
    third = second + np.uint64(seg_len)
    second = second ^ ((h >> np.uint64(18)) & mask)
    third = third ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter holding every key (duplicates allowed); no key at all gives an empty filter."""
    keys = np.unique(np.asarray(keys).astype(np.uint64, copy=False))
    n = len(keys)
    if n == 0:
        return _HEAD.pack(0, 0, 0, 0)
    seg_len = min(1 << 18, 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    seg_count = max(1, -(-int(n * factor) // seg_len) - 2)
    for attempt in range(200):
        if attempt and attempt % 20 == 0:
            seg_count += 1 + seg_count // 8
        seed = (attempt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
        h = _mix(keys, seed)
        order = _peel(_slots(h, seg_len, seg_count), seg_len * (seg_count + 2))
        if order is None:
            continue
        cells = np.zeros(seg_len * (seg_count + 2), np.uint8)
        slots, prints = _slots(h, seg_len, seg_count), _prints(h)
        for own_keys, own_slots in reversed(order):
            cells[own_slots] = 0
            cells[own_slots] = prints[own_keys] ^ np.bitwise_xor.reduce(cells[slots[own_keys]], axis=1)
        return _HEAD.pack(seed, seg_len, seg_count, n) + cells.tobytes()
    raise RuntimeError("no binary fuse filter found; the keys' mixing is at fault")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    count = np.bincount(slots.ravel(), minlength=size)
    who = np.zeros(size, np.int64)
    ids = np.arange(len(slots))
    for k in range(3):
        np.bitwise_xor.at(who, slots[:, k], ids)
    rounds, left = [], len(slots)
    ready = np.flatnonzero(count == 1)
    while len(ready):
        owners, pick = np.unique(who[ready], return_index=True)
        rounds.append((owners, ready[pick]))
        left -= len(owners)
        gone = slots[owners]
        np.subtract.at(count, gone.ravel(), 1)
        for k in range(3):
            np.bitwise_xor.at(who, gone[:, k], owners)
        touched = np.unique(gone)
        ready = touched[count[touched] == 1]
    return rounds if left == 0 else None


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key that was put in, and for about one in 256 of the others."""
    seed, seg_len, seg_count, n = _HEAD.unpack_from(blob)
    keys = np.asarray(keys).astype(np.uint64, copy=False)
    if n == 0:
        return np.zeros(len(keys), bool)
    cells = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    h = _mix(keys, seed)
    return np.bitwise_xor.reduce(cells[_slots(h, seg_len, seg_count)], axis=1) == _prints(h)
