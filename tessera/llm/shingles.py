"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.common import U64, byte_slices, mix

WORDS = 5
ORDER = mix(np.arange(1001, 1001 + 64, dtype=U64)) | U64(1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Polynomial hashes are taken modulo this prime, with two bases.
PRIME = (1 << 31) - 1
BASES = (1_270_593_727, 786_438_193)
M, SHIFT = U64(PRIME), U64(31)

_powers: dict[int, np.ndarray] = {}


def modulo(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 modulo PRIME."""
    x = (x & M) + (x >> SHIFT)
    x = (x & M) + (x >> SHIFT)
    return np.where(x >= M, x - M, x)


def upto(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo PRIME."""
    p = _powers.get(base, np.ones(1, U64))
    while len(p) <= n:
        p = _powers[base] = np.concatenate([p, modulo(p * U64(pow(base, len(p), PRIME)))])
    return p


def prefix(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes for each base: one more entry than bytes."""
    out = np.zeros((len(BASES), len(buf) + 1), U64)
    for row, base in zip(out, BASES, strict=True):
        # Products stay below 2**40, so their sums below 2**63 for 2**23 bytes; longer texts are reduced first.
        terms = (buf.astype(U64) + U64(1)) * upto(len(buf), base)[: len(buf)]
        row[1:] = modulo(np.cumsum(terms if len(buf) < 1 << 23 else modulo(terms)))
    return out


def between(pre: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """62-bit hashes of the bytes from a to b, the same wherever they stand."""
    one, two = (modulo((p[b] + (M - p[a])) * upto(len(p), pow(base, -1, PRIME))[a]) for p, base in zip(pre, BASES, strict=True))
    return (one << SHIFT) | two


def shingles(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``words`` words, in order of texts; a text of fewer words is one shingle, one of none has none. Words lie between ASCII white space."""
    space = SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    end = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    doc = np.searchsorted(off, start, "right") - 1
    word = mix(between(prefix(buf), start, end))
    first = np.searchsorted(doc, doc)  # of the text's words
    count = np.searchsorted(doc, doc, "right") - first
    nth = np.arange(len(doc)) - first
    with np.errstate(over="ignore"):
        h = np.zeros(len(doc), U64)
        for k in range(words):
            h[: len(h) - k] += np.where(nth[: len(h) - k] + k < count[: len(h) - k], word[k:] * ORDER[k], U64(0))
        kept = (nth + words <= count) | (nth == 0)
        return doc[kept], mix(h[kept] + np.minimum(count[kept], words).astype(U64))


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the multiset of each text."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(doc)))


def overlaps(left: pa.Array, right: pa.Array, words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts; 0 where a text has no word."""

    def bag(texts):
        parts = [(i, shingles(buf, off, words)) for i, _, buf, off in byte_slices(texts)]
        return counted(np.concatenate([i + d for i, (d, _) in parts]), np.concatenate([h for _, (_, h) in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))

    (da, ha, ca), (db, hb, cb) = bag(left), bag(right)
    doc, h, c = np.concatenate([da, db]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
    order = np.lexsort((h, doc))
    doc, h, c = doc[order], h[order], c[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    shared = np.bincount(doc[same], np.minimum(c[same], c[same + 1]), len(left))
    total = np.bincount(doc, c, len(left)) - shared
    return np.divide(shared, total, out=np.zeros(len(left)), where=total > 0)
