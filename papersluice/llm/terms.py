"""Texts as arrays: folded characters and hashed terms of a whole batch at once, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from papersluice.llm.lookalike import table

SEPARATOR, WORD, IDEOGRAPH, SKIPPED = 0, 1, 2, 3

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def tables(across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it is folded to (width, case, look-alikes of one character), and its class.

    ``across``: letters of other scripts that look Latin are folded as well, Cyrillic text as a whole included.
    """
    fold = np.arange(0x110000, dtype=np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    alike = table()
    for cp in range(0x20000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        to = alike.get(cp, ch) if across or not 0x370 <= cp < 0x530 else ch
        if to == "":
            kind[cp] = SKIPPED
            continue
        low = (to if len(to) == 1 else ch).lower()
        if across and len(low) == 1:
            low = alike.get(ord(low), low).lower()
        fold[cp] = ord(low) if len(low) == 1 else cp
    for cp in range(0x20000):
        if kind[cp] != SKIPPED and not 0xD800 <= cp < 0xE000:
            f = int(fold[cp])
            if 0x3040 <= f <= 0x30FF or 0x3400 <= f <= 0x9FFF or 0xAC00 <= f <= 0xD7A3 or 0xF900 <= f <= 0xFAFF:
                kind[cp] = IDEOGRAPH
            elif chr(f).isalnum():
                kind[cp] = WORD
    fold[0x20000:] = np.arange(0x20000, 0x110000)
    kind[0x20000:0x30000] = IDEOGRAPH
    return fold, kind


def portions(texts: pa.Array, rows: int, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Slices of a column of at most ``rows`` rows and ``most`` bytes; a longer text makes a slice of its own."""
    sizes = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)]))
    lo, n = 0, len(texts)
    while lo < n:
        hi = min(lo + rows, n, max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most, "right")) - 1))
        yield texts.slice(lo, hi - lo)
        lo = hi


@dataclass
class Chars:
    """Folded characters of a batch; text i has those from bounds[i] to bounds[i + 1], a separator last."""

    codes: np.ndarray
    kinds: np.ndarray
    bounds: np.ndarray


def chars(texts: Sequence[str | None], across: bool = False) -> Chars:
    """Folds a batch of texts; null counts as empty. Invisible characters are gone."""
    fold, kind = tables(across)
    joined = "\n".join([t or "" for t in texts]) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lens)])
    kinds = kind[raw]
    keep = kinds != SKIPPED
    if not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        raw, kinds, bounds = raw[keep], kinds[keep], before[bounds]
    return Chars(fold[raw], kinds, bounds)


_powers_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers_cache or len(_powers_cache[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers_cache[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers_cache[0][:n], _powers_cache[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def terms(c: Chars, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the terms in text order, and the bounds of each text's terms."""
    hashes, bounds = term_hashes(c)
    return (hashes % np.uint64(buckets)).astype(np.int64), bounds


def term_hashes(c: Chars) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms (words, and overlapping pairs of ideographs) in text order, and the bounds of each text's terms."""
    n = len(c.codes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(c.bounds), np.int64)
    word = c.kinds == WORD
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(c.codes.astype(np.uint64) * up[:n], out=sums[1:])
    words = (sums[end] - sums[start]) * down[start]
    han = c.kinds == IDEOGRAPH
    pair = np.flatnonzero(han[:-1] & han[1:])
    pairs = c.codes[pair].astype(np.uint64) * _P + c.codes[pair + 1].astype(np.uint64) + np.uint64(1)
    at = np.concatenate([start, pair])
    order = np.argsort(at, kind="stable")
    return mixed(np.concatenate([words, pairs])[order]), np.searchsorted(at[order], c.bounds)
