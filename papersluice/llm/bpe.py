"""Byte-level BPE encoding of a corpus with a public vocabulary.

A text is cut into pieces by the vocabulary's pattern; pieces repeat, so each Python worker keeps
the ids of the pieces it has met and only new ones are encoded. A piece is encoded over a segment
tree on its byte positions: a leaf holds the rank of the pair that starts there, every node the
leftmost minimum below it, so the root names the next merge and a merge is three point updates
(the pair itself, its left neighbour, the swallowed position) of logarithmic cost. Many short pieces
share one array of trees and go through their merges side by side; rare long ones get a tree each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from papersluice.llm.terms import portions
from papersluice.session import spread

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the splitting pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker keeps before it starts afresh; bounds memory, not the result.
MEMO_PIECES = 300_000
#: Rows of a size class from which their trees are built side by side.
SIDE_BY_SIDE = 16
#: Cells of one array of trees.
CELLS = 1 << 21

NONE = np.iinfo(np.int64).max


def _byte_symbols() -> dict[str, int]:
    """The vocabulary files' printable stand-ins for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Pair of ids -> rank of its merge, as an open-addressed table that whole arrays look up at once."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray, width: int):
        self.width = width
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NONE, np.int64)
        for rank, key in enumerate((left * width + right).tolist()):
            at = self._slot(key)
            while self.keys[at] not in (-1, key):
                at = (at + 1) & ((1 << self.BITS) - 1)
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = key, rank
        self.one = {k: r for k, r in zip(self.keys.tolist(), self.ranks.tolist()) if k >= 0}

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 13) & ((1 << self.BITS) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((held != key) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[at[open_]]
            out[open_] = np.where(held == key[open_], self.ranks[at[open_]], NONE)
            open_ = open_[(held != key[open_]) & (held != -1)]
        return out


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for symbol, byte in _byte_symbols().items():
            self.byte_ids[byte] = vocab[symbol]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.width = max(vocab.values()) + 1
        self.table = PairTable(np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64), self.width)

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each piece, without any splitting."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) < 2:
                out[i] = self.byte_ids[np.frombuffer(p, np.uint8)]
            else:
                classes.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            if len(members) < SIDE_BY_SIDE and bits > 4:
                for i in members:
                    out[i] = self._one(pieces[i])
                continue
            step = max(1, CELLS >> bits)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._many([pieces[i] for i in part], bits)):
                    out[i] = ids
        return out

    def _many(self, pieces: list[bytes], bits: int) -> list[np.ndarray]:
        """Pieces of at most 2**bits bytes; row r of every array belongs to piece r."""
        m, cap = len(pieces), 1 << bits
        lens = np.fromiter(map(len, pieces), np.int64, m)
        inside = np.arange(cap) < lens[:, None]
        ids = np.full((m, cap + 1), -1, np.int32)
        ids[:, :cap][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, cap + 2, dtype=np.int32), (m, cap + 1)).copy()
        after[np.arange(m), lens - 1] = cap
        before = np.broadcast_to(np.arange(-1, cap, dtype=np.int32), (m, cap + 1)).copy()

        tree = np.full((m, 2 * cap), NONE, np.int64)
        paired = inside[:, 1:]
        rank = self.table.rank(ids[:, : cap - 1][paired], ids[:, 1:cap][paired])
        tree[:, cap : 2 * cap - 1][paired] = self._key(rank, np.nonzero(paired)[1], cap)
        for width in (1 << b for b in range(bits - 1, -1, -1)):
            level = tree[:, 2 * width : 4 * width]
            tree[:, width : 2 * width] = np.minimum(level[:, ::2], level[:, 1::2])

        row = np.flatnonzero(tree[:, 1] != NONE)
        flat, stride = tree.reshape(-1), 2 * cap
        while len(row):
            root = tree[row, 1]
            at = root & (cap - 1)
            new = self.merged[root >> bits]
            gone = after[row, at]
            nxt = after[row, gone]
            prv = before[row, at]
            ids[row, at] = new
            ids[row, gone] = -1
            after[row, at] = nxt
            before[row, nxt] = at  # column cap takes the writes of pieces that end here

            right, left = np.flatnonzero(nxt < cap), np.flatnonzero(prv >= 0)
            key = np.full(len(row), NONE, np.int64)
            key[right] = self._key(self.table.rank(new[right], ids[row[right], nxt[right]]), at[right], cap)
            base = row * stride + cap
            flat[base + at] = key
            flat[base + gone] = NONE
            flat[base[left] + prv[left]] = self._key(self.table.rank(ids[row[left], prv[left]], new[left]), prv[left].astype(np.int64), cap)
            top = np.concatenate([row, row, row[left]]) * stride
            node = np.concatenate([at, gone, prv[left]]) + cap
            for _ in range(bits):
                node >>= 1
                child = top + 2 * node
                flat[top + node] = np.minimum(flat[child], flat[child + 1])
            row = row[tree[row, 1] != NONE]
        body = ids[:, :cap]
        kept = body >= 0
        return np.split(body[kept], np.cumsum(kept.sum(1))[:-1])

    @staticmethod
    def _key(rank: np.ndarray, pos: np.ndarray, cap: int) -> np.ndarray:
        """Rank first, then position: the minimum is the leftmost pair of least rank."""
        return np.where(rank == NONE, NONE, np.where(rank == NONE, 0, rank) * cap + pos)

    def _one(self, piece: bytes) -> np.ndarray:
        """One piece of any length."""
        n = len(piece)
        cap = 1 << (n - 1).bit_length()
        none = int(NONE)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = self.table.rank(ids[:-1], ids[1:])
        leaves = np.full(cap, NONE, np.int64)
        leaves[: n - 1] = self._key(rank, np.arange(n - 1), cap)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = np.concatenate([[none], *levels[::-1]]).tolist()
        sym, merged, table, width = ids.tolist(), self.merged, self.table.one, self.width
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(pos: int, key: int) -> None:
            node = pos + cap
            tree[node] = key
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        def key_of(pos: int, right: int) -> int:
            r = table.get(sym[pos] * width + sym[right])
            return none if r is None else r * cap + pos

        while tree[1] != none:
            r, at = divmod(tree[1], cap)
            gone = after[at]
            nxt, prv = after[gone], before[at]
            sym[at], sym[gone] = int(merged[r]), -1
            after[at] = nxt
            put(gone, none)
            put(at, key_of(at, nxt) if nxt < n else none)
            if nxt < n:
                before[nxt] = at
            if prv >= 0:
                put(prv, key_of(prv, at))
        return np.array([s for s in sym if s >= 0], np.int32)


class PieceMemo(dict):
    """Piece -> number, in order of first sight."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class CorpusEncoder:
    """Encodes batches of texts; pieces met before are not encoded again."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.split = bpe, regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.memo = PieceMemo()
        self.flat, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def _add(self, pieces: list[str]) -> None:
        new = self.bpe.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
        ends = self.starts[-1] + np.cumsum([len(x) for x in new])
        if ends[-1] > len(self.flat):
            self.flat = np.resize(self.flat, max(int(ends[-1]), 2 * len(self.flat)))
        self.flat[self.starts[-1] : ends[-1]] = np.concatenate(new)
        self.starts = np.concatenate([self.starts, ends])

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offset at which each text's ids begin (and the last end)."""
        if len(self.memo) > MEMO_PIECES:
            self._reset()
        number, known = self.memo.__getitem__, len(self.memo)
        rows = []
        for t in texts:
            pieces = self.split(t) if t else ()
            rows.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if len(self.memo) > known:
            fresh = list(self.memo)[known:] if known < 1000 else [k for k, _ in zip(reversed(self.memo), range(len(self.memo) - known))][::-1]
            self._add(fresh)
        piece = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        size = self.starts[piece + 1] - self.starts[piece]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) + np.repeat(self.starts[piece] - ends[:-1], size)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return self.flat[take], ends[bounds]


@lru_cache(maxsize=2)
def _encoder(path: str) -> CorpusEncoder:
    return CorpusEncoder(ByteBpe(path))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """``id_col`` and ``ids``, the list of integer ids of each row's text.

    Every row of ``df`` gives one row, repeated ones and those with a null id included; empty and
    null texts give an empty list. Strings that look like special tokens are ordinary text. Texts of
    any length are encoded whole. Other columns are dropped before the texts reach Python. Nothing
    is shuffled; the vocabulary (``vocabulary``, readable on every executor) has a fixed size.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            at = 0
            for part in portions(batch.column(1), 2048):
                ids, bounds = encoder.encode(part.to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists], names=[id_col, "ids"])
                at += len(part)

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
