"""Word and shingle hashes of whole texts, for many documents at once, in numpy.

Texts come as Arrow string columns, so no Python string is made. Words are runs of
bytes other than the six ASCII white-space ones, which is the same on UTF-8 bytes
and on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd 64-bit multipliers (golden-ratio and splitmix64 constants) and the shifts between them.
BASE, STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes of text that are worked on at once; a longer document is worked on alone, whole.
CHUNK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            run = np.full(size, np.uint64(base))
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"][:n], _powers["down"][:n]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents of about so many bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words' byte spans, and for each document the number of its first word, with one more at the end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, equal for equal words wherever they stand."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of runs of k words; a document of fewer words has one, of all of them, and one without words has none."""
    counts = np.diff(first)
    n = len(words)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        whole = whole * np.uint64(STEP) + words[i : i + len(whole)]
    last = np.repeat(first[1:], counts)[: len(whole)]
    keep = np.arange(len(whole)) + k <= last
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    place = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=place[1:])
    out = np.zeros(place[-1], np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    fill = np.ones(len(out), bool)
    fill[place[short]] = False
    out[fill] = mix(whole[keep])
    for d in short:
        h = 0
        for w in words[first[d] : first[d + 1]].tolist():
            h = (h * STEP + w) & 0xFFFFFFFFFFFFFFFF
        out[place[d]] = mix(np.array([h ^ (int(counts[d]) * BASE & 0xFFFFFFFFFFFFFFFF)], np.uint64))[0]
    return out, place


def shingle_sets(col: pa.Array, k: int = 5, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last, hashes, first hash of each): shingles of whole texts, chunk by chunk, repeats included."""
    data, offsets = column_bytes(col)
    for i, j, part, at in chunks(data, offsets):
        part = _LOWER[part] if lower else part
        starts, ends, first = word_spans(part, at)
        yield i, j, *shingle_hashes(word_hashes(part, starts, ends), first, k)
