"""Vectorised text kernels over Arrow string columns (NumPy on the raw UTF-8 buffer).

Every kernel works on whole texts. A batch is cut into slices of about SLICE_BYTES so that memory
stays bounded; one text longer than that is a slice of its own.
Hashes are 64-bit: sums of position-weighted random byte values modulo 2**64, shifted to a common
origin and passed through a finalising mixer.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A worker goes from task to task: arrays of a megabyte or more go back to the system once they are freed,
# where the C library can be told so, and do not stay with it.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD

SLICE_BYTES = 1 << 20
_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_RINV = _U(pow(int(_R), -1, 1 << 64))
_Q = _U(0xD1342543DE82EF95 | 1)
_QINV = _U(pow(int(_Q), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h):
    """Finalising mixer (the public splitmix64 constants)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of a base and of its inverse, grown on demand and kept up to KEEP entries."""

    KEEP = 1 << 23

    def __init__(self, base, inverse):
        self.base, self.inverse, self.n = base, inverse, 0

    def get(self, n):
        if n <= self.n:
            return self.up[:n], self.down[:n]
        up, down = (np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(max(n, 1) - 1, b, _U))]) for b in (self.base, self.inverse))
        if n <= self.KEEP:
            self.up, self.down, self.n = up, down, n
        return up, down


_BYTES, _WORDS = _Powers(_R, _RINV), _Powers(_Q, _QINV)


def slices(batch: pa.RecordBatch, text: str = "text"):
    """Cut a batch into (first row, rows, bytes as uint8, offsets); null texts count as empty."""
    col = batch.column(batch.schema.get_field_index(text))
    col = pc.fill_null(col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col, b"")
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, len(col))
        yield at, to, data[off[at] : off[to]], (off[at : to + 1] - off[at])
        at = to


def spans(data, off, member=WORD):
    """Maximal runs of member bytes inside each text: (starts, ends, first run of each text, plus the total)."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    m = member[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    s[first] = m[first]
    e[last] = m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def byte_prefix(data):
    """Prefix sums for run_hash."""
    up, _ = _BYTES.get(len(data) + 1)
    p = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=p[1:])
    return p


def run_hash(prefix, starts, ends):
    """64-bit hashes of byte runs, from byte_prefix."""
    _, down = _BYTES.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(data, off, lower=False):
    """(hashes, starts, ends, bounds) of all words; bounds[i]:bounds[i+1] are the words of text i."""
    if lower:
        data = LOWER[data]
    s, e, b = spans(data, off)
    return run_hash(byte_prefix(data), s, e), s, e, b


def gram_hashes(w, bounds, n):
    """Hashes of n consecutive words: (hashes, start word, text) of those that lie in one text."""
    total = len(w) - n + 1
    if total <= 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, _U), e, e
    up, down = _WORDS.get(len(w) + 1)
    p = np.zeros(len(w) + 1, _U)
    np.cumsum(w * up[: len(w)], out=p[1:])
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0))
    at = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(size - n + 1, 0)) - np.maximum(size - n + 1, 0), np.maximum(size - n + 1, 0)) + bounds[text]
    return mix((p[at + n] - p[at]) * down[at]), at, text


def sequence_hashes(w, bounds):
    """A hash of each text's whole sequence of words."""
    up, down = _WORDS.get(len(w) + 1)
    p = np.concatenate([np.zeros(1, _U), np.cumsum(w * up[: len(w)], dtype=_U)])
    return mix((p[bounds[1:]] - p[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(_U))


def repeats(key):
    """Boolean per entry: the same key occurs elsewhere too."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    d = np.zeros(len(key), bool)
    d[1:] |= same
    d[:-1] |= same
    out = np.zeros(len(key), bool)
    out[order] = d
    return out


def covered(starts, length, total):
    """Boolean per position: inside some run of the given length from starts."""
    d = np.zeros(total + length + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=len(d)).astype(np.int32))
    ends = starts + length
    d -= np.bincount(ends, minlength=len(d)).astype(np.int32)
    return np.cumsum(d[:total]) > 0


def per_text(values, bounds):
    """Sums of values over each text's entries."""
    p = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return p[bounds[1:]] - p[bounds[:-1]]


def shingle_sets(data, off, n=3):
    """Distinct n-word shingle hashes of each text, lower-casing A-Z: (sorted hashes, bounds).

    A text of fewer than n words, but one at least, has its whole sequence as its one shingle.
    """
    w, _, _, b = word_hashes(data, off, lower=True)
    h, _, text = gram_hashes(w, b, n)
    size = np.diff(b)
    for k in range(1, n):
        if len(short := np.flatnonzero(size == k)):
            g, _, t = gram_hashes(w, b, k)
            pick = np.isin(t, short)
            h, text = np.concatenate([h, mix(g[pick] + _U(k))]), np.concatenate([text, t[pick]])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.searchsorted(text[keep], np.arange(len(off)))


def column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def trimmed(run):
    """A function over batches that gives unused memory back when its task ends."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return go
