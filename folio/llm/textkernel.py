"""Words of whole Arrow batches by numpy: spans, 64-bit hashes and shingles, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Masks of the first 0 to 8 bytes of eight.
SHORT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of the texts in them; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most limit bytes together, or single longer texts."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n+1 positions of each text's words among them."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts_here[edge] = inside[1:-1][edge]
    ends_here[edge - 1] = inside[1:-1][edge - 1]
    starts = np.flatnonzero(starts_here)
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def split_long(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20, within: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """New offsets in which no text is much longer than limit, and the old text of each new one.

    Longer texts are cut after white space, however far that is, or at most `within` bytes from where they are due."""
    if not len(offsets) or (np.diff(offsets) <= limit).all():
        return offsets, np.arange(len(offsets) - 1)
    cuts = [offsets]
    for i in np.flatnonzero(np.diff(offsets) > limit).tolist():
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > limit:
            stop = at + limit
            while stop < end and (within is None or stop < at + limit + within):  # the first white space, looked for in steps
                space = np.flatnonzero(IS_SPACE[data[stop : min(end, stop + 4096)]])
                if len(space):
                    stop += int(space[0]) + 1
                    break
                stop = min(end, stop + 4096)
            if stop >= end:
                break
            cuts.append(np.array([stop]))
            at = stop
    fine = np.unique(np.concatenate(cuts)) if len(np.unique(offsets)) == len(offsets) else np.sort(np.concatenate(cuts))
    extra = np.concatenate(cuts[1:]) if len(cuts) > 1 else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), 1 + np.bincount(np.searchsorted(offsets, extra, "right") - 1, minlength=len(offsets) - 1))
    return fine, owner


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n+1 positions of each text's words among them."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts_here[edge] = inside[1:-1][edge]
    ends_here[edge - 1] = inside[1:-1][edge - 1]
    starts = np.flatnonzero(starts_here)
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; behind the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long_: int = 256) -> np.ndarray:
    """64-bit hashes of spans that depend on their bytes alone, not on their place.

    Spans are read eight bytes at a time, all spans together, and every eight bytes are mixed in by a bijection, so spans of up
    to eight bytes and of equal length never collide. Spans of over long_ bytes are hashed by BLAKE2b."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * U(BASE) + U(0x2545F4914F6CDD1D))
    big = np.flatnonzero(size > long_)
    if len(big):
        raw = data.tobytes()
        out[big] = [int.from_bytes(blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[big].tolist(), ends[big].tolist(), strict=True)]
    eight = eights(data)
    rest = np.flatnonzero((size > 0) & (size <= long_))
    at, left = starts[rest], size[rest]
    while len(rest):
        block = eight[at] & SHORT[np.minimum(left, 8)]
        out[rest] = mix(out[rest] * U(BASE) + block)
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray, long_: int = 256) -> np.ndarray:
    """Whether spans of a and b of the same sizes hold the same bytes."""
    out = np.ones(len(size), bool)
    for i in np.flatnonzero(size > long_).tolist():
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + size[i]], b[b_starts[i] : b_starts[i] + size[i]])
    rest = np.flatnonzero((size > 0) & (size <= long_))
    x, y = eights(a), eights(b)
    at, to, left = a_starts[rest], b_starts[rest], size[rest]
    while len(rest):
        same = (x[at] ^ y[to]) & SHORT[np.minimum(left, 8)] == 0
        out[rest[~same]] = False
        more = same & (left > 8)
        rest, at, to, left = rest[more], at[more] + 8, to[more] + 8, left[more] - 8
    return out


def _word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = words(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), starts, ends, at


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words, and the n+1 positions of each text's words. Long data is read in parts."""
    if len(data) <= 1 << 22:
        return _word_hashes(data, offsets, lower)
    fine, _ = split_long(data, offsets)
    parts = []
    for lo, hi in blocks(fine):
        base = fine[lo]
        hashes, starts, ends, _ = _word_hashes(data[base : fine[hi]], fine[lo : hi + 1] - base, lower)
        parts.append((hashes, starts + base, ends + base))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets, "left")


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as bytes, with A-Z lower-cased and a space after each word, and the n+1 offsets of the texts."""
    starts, ends, at = words(data, offsets)
    size = ends - starts + 1
    first = np.cumsum(size) - size
    total = int(size.sum())
    shown = LOWER[np.append(data, np.uint8(32))[np.repeat(starts - first, size) + np.arange(total)]]
    shown[first + size - 1] = 32
    return shown, np.append(first, total)[at]


def shingles(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words of each text, and their n+1 positions.

    A text of fewer words, but at least one, has a single shingle of all its words; one without words has none."""
    n = np.diff(at)
    many = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(at[:-1] - out_at[:-1], many) + np.arange(out_at[-1])
    last = np.repeat(at[1:], many)
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        place = first + k
        ok = place < last
        total += np.where(ok, hashes[np.minimum(place, len(hashes) - 1)] if len(hashes) else U(0), U(k + 1)) * U(pow(BASE, k + 1, 1 << 64))
    return mix(total), out_at
