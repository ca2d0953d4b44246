"""Byte slices of UTF-8 buffers as numpy arrays: boundaries by a lookup table, XXH64 of all slices of a length at once, groups of equal bytes.

Texts are taken as they lie in an Arrow column, one after the other; no text or word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64
#: Bytes of text that are cut and grouped at a time (one longer text makes a longer block).
BLOCK = 1 << 21
#: Slices over this length are hashed and compared one by one.
LONG = 256
#: The seed that Spark's ``xxhash64`` starts with.
SEED = 42
# Constants of XXH64.
P1, P2, P3, P4, P5 = (_U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def lookup(*outside: int | range) -> np.ndarray:
    """256 flags: false for the bytes given, true for those inside a word."""
    inside = np.ones(256, bool)
    for b in outside:
        inside[b if isinstance(b, int) else list(b)] = False
    return inside


@dataclass
class Block:
    """Consecutive texts: their lower-cased bytes, the n + 1 bounds, and the place of the first in its column."""

    raw: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The texts of a column (null: empty) in blocks of about ``size`` bytes, A-Z lower-cased."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield Block(LOWER[raw[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a], a)
        a = b


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that cross no text bound."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], after[:-1] = inside, inside
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


def padded(raw: np.ndarray) -> np.ndarray:
    """``raw`` with room for reading eight bytes from any of its places."""
    out = np.zeros(len(raw) + 16, np.uint8)
    out[: len(raw)] = raw
    return out


def _lanes(raw: np.ndarray) -> np.ndarray:
    """Element i: the eight bytes from place i on, little-endian. A view."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << _U(n) | x >> _U(64 - n)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def _hash_of_length(lanes: np.ndarray, at: np.ndarray, length: int, seed: np.ndarray) -> np.ndarray:
    place = 0
    if length >= 32:
        v = [seed + P1 + P2, seed + P2, seed.copy(), seed - P1]
        while place + 32 <= length:
            v = [_round(x, lanes[at + (place + 8 * i)]) for i, x in enumerate(v)]
            place += 32
        acc = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
    else:
        acc = seed + P5
    acc = acc + _U(length)
    while place + 8 <= length:
        acc = _turn(acc ^ _round(np.zeros_like(acc), lanes[at + place]), 27) * P1 + P4
        place += 8
    if place + 4 <= length:
        acc = _turn(acc ^ (lanes[at + place] & _U(0xFFFFFFFF)) * P1, 23) * P2 + P3
        place += 4
    while place < length:
        acc = _turn(acc ^ (lanes[at + place] & _U(0xFF)) * P5, 11) * P1
        place += 1
    acc = (acc ^ acc >> _U(33)) * P2
    acc = (acc ^ acc >> _U(29)) * P3
    return acc ^ acc >> _U(32)


def _classes(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of the slices that have it), lengths ascending."""
    if not len(lengths):
        return
    order = np.argsort(lengths.astype(np.uint16), kind="stable") if lengths.max() < 1 << 16 else np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    cuts = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1, append=ordered[-1] + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(ordered[a]), order[a:b]


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """XXH64 of each slice of ``raw`` (``padded``), with a seed of each or ``SEED``: what Spark's ``xxhash64`` gives for its string."""
    out, lanes = np.zeros(len(starts), "u8"), _lanes(raw)
    seeds = np.full(len(starts), SEED, "u8") if seeds is None else seeds
    for length, at in _classes(ends - starts):
        if length <= LONG:
            out[at] = _hash_of_length(lanes, starts[at], length, seeds[at])
        else:
            out[at] = [xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].data, seed=int(seeds[i])) for i in at.tolist()]
    return out


def grouped(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one slice of each group, group of each slice): groups of equal bytes of slices of ``raw`` (``padded``).

    Slices are sorted by XXH64 within their length; neighbours with one hash are compared byte by byte, and where
    two texts share a hash the class is sorted by its bytes as well.
    """
    group, heads, n, lanes = np.zeros(len(starts), np.int64), [], 0, _lanes(raw)
    for length, at in _classes(ends - starts):
        begin = starts[at]
        if length > LONG:
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(raw[s : s + length].tobytes(), len(known)) for s in begin.tolist()])
            first = np.unique(ids, return_index=True)[1]
            order, new = None, first
        else:
            h = _hash_of_length(lanes, begin, length, np.full(len(at), SEED, "u8"))
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            equal = _equal(lanes, begin[order], length)
            if (same & ~equal).any():  # two texts of one hash
                keys = [_lane(lanes, begin, length, i) for i in range(0, length, 8)]
                order = np.lexsort([*keys, h])
                same, equal = h[order][1:] == h[order][:-1], _equal(lanes, begin[order], length)
            fresh = np.ones(len(at), bool)
            fresh[1:] = ~(same & equal)
            ids = np.empty(len(at), np.int64)
            ids[order] = np.cumsum(fresh) - 1
            new = order[fresh]
        heads.append(at[new])
        group[at] = n + ids
        n += len(new)
    return (np.concatenate(heads) if heads else np.zeros(0, np.int64)), group


def _lane(lanes: np.ndarray, begin: np.ndarray, length: int, place: int) -> np.ndarray:
    left = length - place
    return lanes[begin + place] if left >= 8 else lanes[begin + place] & _U((1 << 8 * left) - 1)


def _equal(lanes: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Whether the bytes of each slice are those of the one before it."""
    out = np.ones(max(0, len(begin) - 1), bool)
    for place in range(0, length, 8):
        lane = _lane(lanes, begin, length, place)
        out &= lane[1:] == lane[:-1]
    return out


def strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as an Arrow column of strings."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = raw[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sum of each weight over the rows of a key."""
    order = np.argsort(keys)
    ordered = keys[order]
    cuts = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1)) if len(ordered) else np.zeros(0, np.int64)
    return ordered[cuts], *(np.add.reduceat(w[order], cuts) if len(cuts) else w[:0] for w in weights)
