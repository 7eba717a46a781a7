"""Hashed word shingles in numpy.

Words are maximal runs of bytes outside \\x20 and \\x09-\\x0D, with A-Z lower-cased. A word's hash mixes
its length and its bytes, eight at a time; no structure of a word carries over. Long words are
hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix

WORDS = 5
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: Bytes hashed at once; a longer text is cut at a blank.
SEGMENT = 1 << 20
#: Bytes of the longest words that are mixed in numpy.
LONG = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a normalised block."""
    a = np.frombuffer(block, np.uint8)
    w = np.zeros(len(a) + 2, np.int8)
    w[1:-1] = a != 0x20
    edge = np.diff(w)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    padded = block + bytes(8)
    eight = np.ndarray(len(a) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) * _STEP)
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = size[at] - k
        part = eight[start[at] + k]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[at] = mix((h[at] ^ part) * _STEP + np.uint64(k + 1))
        at = at[left > 8]
        if not len(at):
            break
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(block[start[i] : end[i]], digest_size=8).digest(), "little")
    return h, start


def word_hashes(texts: list[str | None]):
    """Hashes of the words of each text, one array a text."""
    out: list = [None] * len(texts)
    run, at, size = [], [], 0

    def flush():
        if run:
            h, start = _hash(b" ".join(run))
            cuts = np.searchsorted(start, np.cumsum([len(b) + 1 for b in run]))
            for i, own in zip(at, np.split(h, cuts[:-1])):
                out[i] = own
            run.clear()
            at.clear()

    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass").translate(_TABLE) if t else b""
        if len(b) > SEGMENT:
            parts, k = [], 0
            while k < len(b):
                end = len(b) if len(b) - k <= SEGMENT else b.rfind(b" ", k, k + SEGMENT) + 1 or b.find(b" ", k + SEGMENT) + 1 or len(b)
                parts.append(_hash(b[k:end])[0])
                k = end
            out[i] = np.concatenate(parts)
            continue
        run.append(b)
        at.append(i)
        size += len(b)
        if size > SEGMENT // 2:
            flush()
            size = 0
    flush()
    return out


_COEFFICIENTS = mix(np.arange(11, 11 + WORDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle; none are none."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mix((words * _COEFFICIENTS[:n]).sum(keepdims=True) + np.uint64(n))
    h = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        h += words[k : n - WORDS + 1 + k] * _COEFFICIENTS[k]
    h = np.sort(mix(h))
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    return [shingle_set(w) for w in word_hashes(texts)]
