"""Words of whole Arrow batches as numpy arrays: bytes are classified, split and hashed without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def _byte_class(rule) -> np.ndarray:
    return np.array([rule(b) for b in range(256)])


SPACED = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
CODES = np.random.default_rng(20_240_601).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE, BASE_INVERSE = U(0x9E3779B97F4A7C13), U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
STEP = U(0xC2B2AE3D27D4EB4F)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the start of each (NULL is empty)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hash()."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * powers(len(data) + 1)[0][:-1], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; the same bytes give the same value wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * STEP)


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of every word; a word never crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_hashes(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, start and end of every word, with A-Z lower-cased."""
    data, offsets = flat(texts)
    data = LOWER[data]
    doc, starts, ends = split(data, offsets, kind)
    return doc, span_hash(prefix_hash(data), starts, ends), starts, ends


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values; element i is for h[i:i+n]."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, f = np.zeros(m, np.uint64), U(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += h[j : j + m] * f
            f = f * STEP
    return mix(out + U(n))


def shingles(texts: pa.Array, kind: np.ndarray = SPACED, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct n-word shingle, sorted by text and hash; a text of fewer
    words has its whole sequence as its only shingle, one without words none."""
    rows = len(texts)
    doc, h, _, _ = word_hashes(texts, kind)
    count = np.bincount(doc, minlength=rows)
    first = np.cumsum(count) - count
    g = gram_hash(h, n)
    keep = doc[: len(g)] == doc[n - 1 :] if len(g) else np.zeros(0, bool)
    docs, values = [doc[: len(g)][keep]], [g[keep]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            docs.append(short)
            values.append(gram_hash(h, k)[first[short]])
    docs, values = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]
