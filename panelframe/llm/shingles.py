"""Word n-gram sets of texts, hashed over whole Arrow batches with NumPy."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Bytes that are hashed at once; a longer text is cut at white space into such pieces.
PIECE = 1 << 18
# Longer words are hashed one by one.
LONG_WORD = 256
# Base of the words' polynomial hash, modulo 2^64: odd, so that it has an inverse.
BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def _byte_values() -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * P1)
    out[65:91] = out[97:123]
    return out


SPACE, VALUE = _is_space(), _byte_values()


@functools.cache
def _powers(base: int, count: int) -> np.ndarray:
    out, done = np.ones(count, np.uint64), 1
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words of data, and where those of each text start and end among them)."""
    size = len(data)
    room = max(PIECE, 1 << int(size).bit_length()) + 1
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = starts[starts < size]
    first[inner] = word[inner]
    inner = ends[ends > 0] - 1
    last[inner] = word[inner]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(VALUE[data] * _powers(BASE, room)[:size], out=total[1:])
    length = b - a
    h = mix((total[b] - total[a]) * _powers(pow(BASE, -1, 1 << 64), room)[a] + length.astype(np.uint64) * P1)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[a[i] : b[i]].tobytes().lower())
    return h, np.searchsorted(a, starts), np.searchsorted(a, ends)


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length."""
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            gap = np.flatnonzero(SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # a word longer than a piece
                while end < len(data) and not SPACE[data[end]]:
                    end = min(end + PIECE, len(data)) if not SPACE[data[end : end + PIECE]].any() else end + int(np.argmax(SPACE[data[end : end + PIECE]]))
        out.append(_words(data[at:end], np.array([0]), np.array([end - at]))[0])
        at = end
    return np.concatenate(out)


def sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the n-word shingles of each text, whole.

    Words are cut at space and 0x09-0x0D, A-Z are lower-cased; a text of fewer than n words has its
    whole sequence as one shingle, a null or wordless one none.
    """
    count = len(texts)
    if not count:
        return []
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + count + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, i = [], 0
    while i < count:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        piece, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
        if len(piece) > PIECE:
            h = _long(piece)
            starts, ends = [0], [len(h)]
        elif len(piece):
            h, starts, ends = (x.tolist() if k else x for k, x in enumerate(_words(piece, offsets[:-1], offsets[1:])))
        else:
            h, starts, ends = np.empty(0, np.uint64), [0] * (j - i), [0] * (j - i)
        key = np.full(max(len(h) - n + 1, 0), n, np.uint64)
        for k in range(n):
            key = key * P1 + h[k : k + len(key)]
        key = mix(key)
        for x, y in zip(starts, ends):
            if y - x >= n:
                s = np.sort(key[x : y - n + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif y > x:
                whole = np.full(1, y - x, np.uint64)
                for k in range(x, y):
                    whole = whole * P1 + h[k : k + 1]
                out.append(mix(whole))
            else:
                out.append(np.empty(0, np.uint64))
        i = j
    return out


def names(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, 128 bits together; 0, 0 for the empty one."""
    size = np.array([len(s) for s in found], np.int64)
    one, two = np.zeros(len(found), np.uint64), np.zeros(len(found), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        every = np.concatenate([found[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        length = size[full].astype(np.uint64)
        one[full] = mix(np.add.reduceat(mix(every + P1), starts) + length * P2)
        two[full] = mix(np.add.reduceat(mix(every * P3 + P2), starts) + length * P1)
    return one.view(np.int64), two.view(np.int64)
