"""Word shingles of whole texts as sorted sets of 64-bit fingerprints, and SuperMinHash sketches of them.

All steps run over blocks of about a megabyte of text as numpy arrays; no loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Text bytes, and texts, that are hashed at a time (one longer text makes a longer block).
BLOCK, TEXTS = 1 << 19, 512
#: An unfilled register.
UNFILLED = _U(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 & ~0x7 | 0x5  # odd; 5 modulo 8, so that its powers have the longest period
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240611))
_LETTER = _random.integers(1, 1 << 63, 256, dtype="u8") * _U(2) + _U(1)
_PLACE = _random.integers(1, 1 << 63, 64, dtype="u8") * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, b, "u8")])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about BLOCK bytes in all, with the place of the first."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text or b""
        if run and size + len(text) > BLOCK:
            yield first, run
            first, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def column_blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """``blocks`` of an Arrow column of texts; only a few texts at a time become Python objects."""
    column = column.cast(pa.binary())
    for at in range(0, len(column), TEXTS):
        for first, run in blocks(column.slice(at, TEXTS).to_pylist()):
            yield at + first, run


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's distinct shingles, ascending within a text, and the n+1 text bounds.

    A-Z is lower-cased; words are runs of other than ASCII white space. A text of fewer words has its
    whole sequence as its one shingle; a text without words has none.
    """
    joined = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_table(len(raw) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(_LETTER[raw] * power[: len(raw)], dtype="u8")])
    word = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at = np.searchsorted(starts, bounds)  # the first word of each text
    count = np.diff(at)
    lengths = np.arange(words + 1, dtype="u8") * _U(0xD6E8FEB86659FD93)
    full = np.zeros(max(0, len(word) - words + 1), "u8")
    for j in range(words):
        full += word[j : j + len(full)] * _PLACE[j]
    full = mix(full + lengths[words:])
    text_of = np.repeat(np.arange(len(texts)), count)
    inside = text_of[: len(full)] == text_of[words - 1 :] if len(full) else np.zeros(0, bool)
    shingle, owner = full[inside], text_of[: len(full)][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        own = [mix((word[at[i] : at[i + 1]] * _PLACE[: count[i]]).sum(dtype="u8", keepdims=True) + lengths[[count[i]]])[0] for i in short]
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        shingle, owner = np.concatenate([shingle, np.array(own, "u8")])[order], np.concatenate([owner, short])[order]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        shingle[a:b].sort()
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def superminhash(sets: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """SuperMinHash signatures (sets x registers) of concatenated sets.

    Element d draws a random permutation by Fisher-Yates steps; step j lowers the register that the
    permutation has at j to j + r, r uniform in [0, 1). A value is kept as j in the high and r in the low
    32 bits. A set stops at the step that fills its last register: later steps only draw larger values.
    """
    n = len(bounds) - 1
    sketch = np.full(n * registers, UNFILLED)
    live = np.diff(bounds) > 0
    owner = np.repeat(np.arange(n), np.diff(bounds))
    element, shuffled = sets, None
    narrow = np.uint8 if registers <= 256 else np.uint16
    for j in range(registers):
        draw = mix(element + _U((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        pick = (j + ((draw & _U(0xFFFFFFFF)) * _U(registers - j) >> _U(32))).astype(np.int64)
        if shuffled is None:
            target = pick
        else:
            rows = np.arange(len(element))
            target = shuffled[rows, pick]
            shuffled[rows, pick] = shuffled[rows, j]
        np.minimum.at(sketch, owner * registers + target, _U(j << 32) + (draw >> _U(32)))
        left = np.flatnonzero(live)
        live[left] = (sketch.reshape(n, registers)[left] == UNFILLED).any(axis=1)
        if not live.any():
            break
        stay = live[owner]
        if not stay.all():
            element, owner, pick = element[stay], owner[stay], pick[stay]
            shuffled = shuffled[stay] if shuffled is not None else None
        if shuffled is None:
            shuffled = np.tile(np.arange(registers, dtype=narrow), (len(element), 1))
            shuffled[np.arange(len(element)), pick] = 0
    return sketch.reshape(n, registers)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key (sets x bands) of each band of registers; the band's number is part of its key."""
    n, registers = sketch.shape
    rows = sketch.reshape(n, bands, registers // bands)
    key = np.arange(1, bands + 1, dtype="u8") * _U(0xA24BAED4963EE407)
    for i in range(rows.shape[2]):
        key = mix(key + rows[:, :, i] * _PLACE[i])
    return key.view("i8")
