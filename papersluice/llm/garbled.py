"""Texts that were decoded with the wrong character encoding: found, and restored where possible.

A chain is what went wrong: the encoding a text was stored in and the one it was read with, once
or twice. A multinomial classifier over hashed byte bigrams is trained on all records garbled by every
chain; against it stand the same bigrams of unharmed records. What it is made of are sums over
records, so every record is counted where it lies. For each chain the stretch of a text
with the greatest log-likelihood ratio is its candidate place, so a text that is garbled in part is
found as well. Chains are taken in the order in which the classifier has them: the first whose
inversion encodes and decodes strictly and reads better than what stands there now, by the
characters that follow one another in unharmed records, is the prediction. A repaired text is
examined again, so stretches harmed by different chains are all put right. Where characters were
lost on the way nothing can be restored, but the loss itself is evidence; ``evidence`` tells such
records apart.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersluice.llm.lookalike import skeleton
from papersluice.llm.terms import portions
from papersluice.session import materialize, spread

#: Hash buckets of byte bigrams.
BUCKETS = 1 << 16
SMOOTHING = 0.02
#: Log-likelihood ratio from which a chain is tried.
TRY_FROM = 1.5
#: Gain in log-likelihood that a restored text needs.
GAIN = 4.0
#: A stretch of ideographs that turns into others has at least so many.
LEAST_IDEOGRAPHS = 3
#: The same for a stretch that inverts but for a few lost characters, or that begins or ends amid a word; characters that the latter has at least.
SURE, LEAST_AMID = 30.0, 5
#: Log-likelihood ratio from which a stretch may have lost characters.
EVIDENT = 15.0

#: Log-likelihood ratio from which a training record does not vouch for the successions in it.
DOUBTFUL = 12.0
#: Log-likelihood a character of text that reads as usual, and of the least usual that is restored.
USUAL, UNUSUAL = -4.5, -8.2
#: Byte bigrams scored at once.
AT_ONCE = 1 << 13
#: Bytes of text that are garbled and counted at once.
COUNTED = 1 << 20
#: More than a prefix sum of AT_ONCE scores can fall.
APART = 1e6

LOST = "�"
#: Stands where a text was cut, so beside any letter.
CUT = "…"
#: How a finding is known: the chain was inverted strictly; it was but for a few characters; characters were replaced and nothing can be inverted.
INVERTED, NEARLY, REPLACED = "inverted", "nearly", "replaced"

#: Stored as -> read as.
SINGLE_BYTE = ("latin-1", "cp1252", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "mac_roman")
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    **{f"utf-8>{w}": (("utf-8", w),) for w in (*SINGLE_BYTE, "gb18030", "big5", "cp932", "cp949")},
    **{f"gb18030>{w}": (("gb18030", w),) for w in ("latin-1", "cp1252", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "mac_roman", "big5", "cp932", "euc_jp", "cp949", "utf-8")},
    **{f"cp1252>{w}": (("cp1252", w),) for w in ("cp437", "cp850", "cp1251", "cp866", "mac_roman", "gb18030", "big5", "utf-8")},
    **{f"{s}>cp1252": ((s, "cp1252"),) for s in ("cp437", "cp850", "cp1251", "cp866", "koi8-r", "mac_roman")},
    "cp850>cp1251": (("cp850", "cp1251"),),
    "cp1251>koi8-r": (("cp1251", "koi8-r"),),
    "koi8-r>cp1251": (("koi8-r", "cp1251"),),
    "cp1251>cp866": (("cp1251", "cp866"),),
    "cp866>cp1251": (("cp866", "cp1251"),),
    "cp1251>utf-8": (("cp1251", "utf-8"),),
    "utf-8>latin-1, twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf-8>cp1252, twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf-8>cp1251, twice": (("utf-8", "cp1251"), ("utf-8", "cp1251")),
    "utf-8>latin-1>cp1252": (("utf-8", "latin-1"), ("utf-8", "cp1252")),
}


def _lenient(encoding: str) -> tuple[str, object]:
    """A single-byte encoding's 256 characters, and the way back; a byte it leaves undefined stands for the control character of its number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), codecs.charmap_build("".join(chars))


_TABLES = {e: _lenient(e) for e in SINGLE_BYTE}


def encode(text: str, encoding: str, errors: str = "strict") -> bytes:
    table = _TABLES.get(encoding)
    return codecs.charmap_encode(text, errors, table[1])[0] if table else text.encode(encoding, errors)


def decode(data: bytes, encoding: str, errors: str = "strict") -> str:
    table = _TABLES.get(encoding)
    return codecs.charmap_decode(data, errors, table[0])[0] if table else data.decode(encoding, errors)


def garble(text: str, chain: str) -> str | None:
    """``text`` after the chain; None if it can't be stored so, or comes through unharmed."""
    out = text
    try:
        for stored, read in CHAINS[chain]:
            out = decode(encode(out, stored), read, "replace")
    except UnicodeError:
        return None
    return None if out == text else out


def invert(text: str, chain: str) -> str:
    """What the chain made ``text`` of; raises UnicodeError unless every step is strict both ways."""
    out, failed = attempt(text, chain)
    if out is None:
        raise UnicodeError(f"{chain}: character {failed}")
    return out


def attempt(text: str, chain: str) -> tuple[str | None, int]:
    """As ``invert``; instead of raising, None and the character at which it failed."""
    back: list[tuple[str, bytes, str, str]] = []
    out = text
    for stored, read in reversed(CHAINS[chain]):
        data = b""
        try:
            data = encode(out, read)
            now = decode(data, stored)
        except UnicodeEncodeError as e:
            at = e.start
        except UnicodeDecodeError as e:
            at = len(decode(data[: e.start], read, "ignore"))
        else:
            back.append((out, data, read, stored))
            out = now
            continue
        for before, data, read, stored in reversed(back):  # to the characters that this step's came of
            at = len(decode(data[: len(encode(out[:at], stored))], read, "ignore"))
            out = before
        return None, min(at, len(text) - 1)
    return out, len(text)


def bigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte bigrams of all texts that are not plain ASCII, the text of each, and the characters at which they begin and end."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    pair = (b[:-1] | b[1:]) & 0x80 != 0
    pair[ends[:-1][ends[:-1] < len(b)] - 1] = False
    at = np.flatnonzero(pair)
    owner = np.searchsorted(ends, at, "right")
    char = np.cumsum((b & 0xC0) != 0x80, dtype=np.int64) - 1
    first = char[np.minimum(np.concatenate([[0], ends[:-1]]), max(len(b) - 1, 0))] if len(b) else np.zeros(len(texts), np.int64)
    return ((b[at].astype(np.int32) << 8 | b[at + 1]) % BUCKETS).astype(np.int32), owner, char[at] - first[owner], char[at + 1] - first[owner]


@lru_cache(maxsize=None)
def _single(chain: str) -> bool:
    return all(e in SINGLE_BYTE for step in CHAINS[chain] for e in step)


def _script(text: str) -> int:
    """0 Latin and others, 1 ideographs, 2 Cyrillic."""
    han = sum("一" <= c <= "鿿" for c in text)
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in text)
    return 0 if not han and not cyrillic else 1 if han >= cyrillic else 2


@lru_cache(maxsize=1 << 16)
def script_of(ch: str) -> str:
    """First word of a letter's name (LATIN, CYRILLIC, CJK ...); empty for anything else."""
    return unicodedata.name(ch, "").partition(" ")[0] if ch.isalpha() else ""


@lru_cache(maxsize=1 << 16)
def _written(ch: str) -> bool:
    return ch in "\t\r\n" or unicodedata.category(ch) not in ("Cc", "Cn", "Co")


class Succession:
    """How likely characters follow one another in unharmed text, whatever their case."""

    BACKOFF, UNSEEN = 2.0, 1e-6

    def __init__(self, pairs: Iterable[tuple[int, int]], texts: int):
        """``pairs``: two code points and how often they follow one another, in ``texts`` texts with a space on either side."""
        self.single: Counter[str] = Counter({" ": texts})
        self.double: dict[str, int] = {}
        for key, n in pairs:
            if n:
                a, b = chr(key >> 21), chr(key & 0x1FFFFF)
                self.single[a] += n
                self.double[a + b] = self.double.get(a + b, 0) + n
        self.total = sum(self.single.values()) or 1

        self._known: dict[str, float] = {}

    def likelihood(self, text: str) -> float:
        t = f" {text.lower()} "
        known, out = self._known, 0.0
        for ab in map(str.__add__, t, t[1:]):
            x = known.get(ab)
            if x is None:
                x = known[ab] = self._log(ab[0], ab[1])
            out += x
        return out

    def _log(self, a: str, b: str) -> float:
        base = self.single.get(b, 0) / self.total + self.UNSEEN
        return math.log((self.double.get(a + b, 0) + self.BACKOFF * base) / (self.single.get(a, 0) + self.BACKOFF))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}


def half_of(text: str) -> int:
    """The half of the texts to which one belongs, wherever it lies."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


class Counts:
    """What a model is made of: byte bigrams of texts by script and after each chain, and successions of each half of the texts. Sums, so parts can be added and taken away."""

    def __init__(self):
        self.clean = np.zeros((3, BUCKETS), np.int64)
        self.garbled = np.zeros((len(CHAINS), BUCKETS), np.int64)
        self.pairs: tuple[Counter[int], Counter[int]] = (Counter(), Counter())
        self.texts = [0, 0]

    def add_bigrams(self, texts: Sequence[str]) -> None:
        script = [_script(t) for t in texts]
        for k in range(3):
            self.clean[k] += count_bigrams([t for t, own in zip(texts, script) if own == k])
        for k, chain in enumerate(CHAINS):
            self.garbled[k] += count_bigrams([g for t in texts if (g := garble(t, chain)) is not None])

    def add_successions(self, texts: Sequence[str]) -> None:
        for half in (0, 1):
            own = [f" {t.lower()} " for t in texts if half_of(t) == half]
            c = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            keep = np.ones(max(len(c) - 1, 0), bool)
            keep[np.cumsum([len(t) for t in own], dtype=np.int64)[:-1] - 1] = False  # from one text to the next
            self.pairs[half].update(dict(zip(*(x.tolist() for x in np.unique((c[:-1] << 21 | c[1:])[keep], return_counts=True)))))
            self.texts[half] += len(own)

    def subtract(self, other: Counts) -> None:
        self.clean -= other.clean
        self.garbled -= other.garbled
        for half in (0, 1):
            self.pairs[half].subtract(other.pairs[half])
            self.texts[half] -= other.texts[half]

    def succession(self, *halves: int) -> Succession:
        return Succession(((x, n) for half in halves for x, n in self.pairs[half].items()), sum(self.texts[half] for half in halves))

    def to_rows(self) -> pa.RecordBatch:
        """All counts but zeros as rows: what is counted, its key, the count."""
        parts = [(k, np.flatnonzero(x), x[x != 0]) for k, x in enumerate([*self.clean, *self.garbled])]
        n = len(parts)
        for half in (0, 1):
            parts.append((n + half, np.fromiter(self.pairs[half].keys(), np.int64), np.fromiter(self.pairs[half].values(), np.int64)))
            parts.append((n + 2 + half, np.zeros(1, np.int64), np.full(1, self.texts[half], np.int64)))
        kinds, keys, counts = (np.concatenate(x) for x in zip(*((np.full(len(at), k, np.int32), at, x) for k, at, x in parts)))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(counts)], names=["kind", "key", "n"])

    @classmethod
    def of_rows(cls, rows: pa.Table) -> Counts:
        """The counts of rows of which no two have the same kind and key."""
        out = cls()
        kind, key, count = (rows[c].to_numpy() for c in ("kind", "key", "n"))
        tables = [*out.clean, *out.garbled]
        for k in np.unique(kind).tolist():
            at, x = key[kind == k], count[kind == k]
            if k < len(tables):
                tables[k][at] = x
            elif k < len(tables) + 2:
                out.pairs[k - len(tables)].update(dict(zip(at.tolist(), x.tolist())))
            else:
                out.texts[k - len(tables) - 2] = int(x[0])
        return out


def count_bigrams(texts: Sequence[str]) -> np.ndarray:
    """How often each bucket is among the byte bigrams of all texts that are not plain ASCII."""
    b = np.frombuffer(b"\xff".join([t.encode("utf-8", "surrogatepass") for t in texts]), np.uint8)
    out = np.zeros(1 << 16, np.int64)
    for lo in range(0, len(b) - 1, COUNTED):
        x = b[lo : lo + COUNTED + 1]
        out += np.bincount(x[:-1].astype(np.uint16) << 8 | x[1:], minlength=1 << 16)
    pair = out.reshape(256, 256)
    pair[:128, :128] = pair[255] = pair[:, 255] = 0  # 255 is in no UTF-8, so it parts the texts
    return out.reshape(-1, BUCKETS).sum(0)


@dataclass
class Finding:
    chain: str
    restored: str | None
    score: float
    evidence: str


#: A text from which a model is learned: whether it does not vouch for its successions, whether it is harmed, and its stretches.
Learned = tuple[str, bool, bool, list[tuple[float, int, int, int]]]


class InMemory:
    """Texts to learn from, in memory."""

    def __init__(self, rows: Sequence[Learned]):
        self.rows = rows

    def step(self, model: EncodingModel, f: Callable[[EncodingModel, Sequence[Learned]], Iterable[Learned]]) -> InMemory:
        return InMemory(list(f(model, self.rows)))

    def count(self, f: Callable[[Counts, Sequence[Learned]], None]) -> Counts:
        out = Counts()
        f(out, self.rows)
        return out


class InTable:
    """The same in a table. What a step leaves is written to the shared folder; only counts reach the driver."""

    SCHEMA = "text string, doubtful boolean, harmed boolean, tried binary"
    NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @staticmethod
    def _read(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[Learned]]:
        for b in batches:
            lo = 0
            for part in portions(b.column(0), 2048, most):
                own = b.slice(lo, len(part))
                tried = ([(s, int(k), int(a), int(z)) for s, k, a, z in np.frombuffer(x).reshape(-1, 4).tolist()] for x in own.column(3).to_pylist())
                yield list(zip(part.to_pylist(), own.column(1).to_pylist(), own.column(2).to_pylist(), tried))
                lo += len(part)

    def step(self, model: EncodingModel, f: Callable[[EncodingModel, Sequence[Learned]], Iterable[Learned]]) -> InTable:
        shared = self.rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in InTable._read(batches, 1 << 22):
                left = [(t, d, h, np.array(x, np.float64).tobytes()) for t, d, h, x in f(shared.value, rows)]
                columns = zip(*left) if left else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.bool_(), pa.binary()))], names=InTable.NAMES)

        left = materialize(spread(self.rows).mapInArrow(run, InTable.SCHEMA), "garbled")
        shared.destroy()
        return InTable(left)

    def count(self, f: Callable[[Counts, Sequence[Learned]], None]) -> Counts:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Counts()
            for rows in InTable._read(batches, COUNTED):
                f(out, rows)
            yield out.to_rows()

        counts = spread(self.rows).mapInArrow(run, "kind int, key bigint, n bigint")
        return Counts.of_rows(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow())


def _count_all(counts: Counts, rows: Sequence[Learned]) -> None:
    texts = [t for t, *_ in rows]
    counts.add_bigrams(texts)
    counts.add_successions(texts)


def _count_doubtful(counts: Counts, rows: Sequence[Learned]) -> None:
    counts.add_successions([t for t, doubtful, *_ in rows if doubtful])


def _count_harmed(counts: Counts, rows: Sequence[Learned]) -> None:
    """Of harmed texts what still counts: successions of doubtful ones don't."""
    counts.add_bigrams([t for t, _, harmed, _ in rows if harmed])
    counts.add_successions([t for t, doubtful, harmed, _ in rows if harmed and not doubtful])


def _suspect(model: EncodingModel, rows: Sequence[Learned]) -> Iterator[Learned]:
    """The texts that some chain explains better, and whether one makes usual text of them."""
    for (t, *_), tried in zip(rows, model.stretches([t for t, *_ in rows])):
        if tried:
            score, k, a, z = tried[0]
            yield t, score >= DOUBTFUL and model._invert(t, a, z, model.chains[k], model._usual) is not None, False, tried


def _harmed(model: EncodingModel, rows: Sequence[Learned]) -> Iterator[Learned]:
    """The harmed texts, and those that may yet be found so by half of the texts."""
    for t, doubtful, _, tried in rows:
        harmed = model._judge(t, tried) is not None
        if harmed or tried[0][0] >= 2 * EVIDENT:
            yield t, doubtful, harmed, tried


def _harmed_of(half: int) -> Callable[[EncodingModel, Sequence[Learned]], Iterator[Learned]]:
    """The other harmed texts of one half, by a model of the successions in the other."""

    def f(model: EncodingModel, rows: Sequence[Learned]) -> Iterator[Learned]:
        for t, doubtful, harmed, tried in rows:
            if not harmed and half_of(t) == half and (x := model._judge(t, tried)) is not None and x.score >= 2 * EVIDENT:
                yield t, doubtful, True, tried

    return f


class EncodingModel:
    """Log-likelihoods of byte bigrams: ``clean`` as unharmed text of the likeliest script, ``ratio`` of each chain against it."""

    def __init__(self, texts: Sequence[str]):
        self._learn(InMemory([(t, False, False, []) for t in dict.fromkeys(texts) if t and not t.isascii() and LOST not in t]))

    @classmethod
    def of(cls, rows: InTable) -> EncodingModel:
        """The same of different texts in a table, none of them plain ASCII or with characters lost."""
        out = cls.__new__(cls)
        out._learn(rows)
        return out

    def _learn(self, rows: InMemory | InTable) -> None:
        self.chains = list(CHAINS)
        counts = rows.count(_count_all)
        self._weigh(counts)
        self._follow(counts.succession(0, 1))
        # Records of which a chain makes usual text don't vouch for their own successions, however many are garbled alike.
        suspects = rows.step(self, _suspect)
        counts.subtract(suspects.count(_count_doubtful))
        self._follow(counts.succession(0, 1))
        suspects = suspects.step(self, _harmed)
        counts.subtract(suspects.count(_count_harmed))
        # A garbled text must not vouch for itself: what is plain is judged by the other half's successions.
        for half in (0, 1):
            self._follow(counts.succession(1 - half))
            counts.subtract(suspects.step(self, _harmed_of(half)).count(_count_harmed))
        self._weigh(counts)
        self._follow(counts.succession(0, 1))

    def _weigh(self, counts: Counts) -> None:
        self.clean = self._log(counts.clean).max(0)
        self.ratio = np.ascontiguousarray((self._log(counts.garbled) - self.clean).T).astype(np.float32)
        self.ratio[:, counts.garbled.sum(1) == 0] = -1

    def _follow(self, succession: Succession) -> None:
        self.succession, self._known = succession, {}

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS))

    def stretches(self, texts: Sequence[str]) -> list[list[tuple[float, int, int, int]]]:
        """For each text the chains whose best stretch has a log-likelihood ratio of TRY_FROM or more, best first: ratio, chain, and the characters it spans."""
        out: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
        idx, owner, begin, end = bigrams(texts)
        size = np.bincount(owner, minlength=len(texts))
        bounds = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + AT_ONCE, "right")) - 1)
            a, z = bounds[lo], bounds[hi]
            if z - a > AT_ONCE:
                found = [(lo, *x) for x in self._long(idx[a:z])]
            elif z > a:
                found = self._short(idx[a:z], owner[a:z] - lo, bounds[lo : hi + 1] - a, lo)
            else:
                found = []
            for i, k, best, first, last in found:
                out[i].append((best, k, int(begin[bounds[i] + first]), int(end[bounds[i] + last]) + 1))
            lo = hi
        for x in out:
            x.sort(key=lambda y: (-y[0], y[1]))
        return out

    def _short(self, idx: np.ndarray, owner: np.ndarray, bounds: np.ndarray, at: int) -> list[tuple[int, int, float, int, int]]:
        """Best stretches of several texts at once: text, chain, ratio, first and last bigram."""
        score = self.ratio[idx].astype(np.float64)
        total = np.cumsum(score, axis=0) - APART * owner[:, None]  # each text lies far below the one before: a minimum never reaches back
        least = np.minimum.accumulate(total - score, axis=0)
        gain = total - least
        texts = np.flatnonzero(np.diff(bounds))
        best = np.maximum.reduceat(gain, bounds[texts], axis=0)
        out = []
        for j, k in zip(*np.nonzero(best >= TRY_FROM)):
            a, z = bounds[texts[j]], bounds[texts[j] + 1]
            last = int(gain[a:z, k].argmax())
            first = int((total[a : a + last + 1, k] - score[a : a + last + 1, k]).argmin())
            out.append((at + int(texts[j]), int(k), float(best[j, k]), first, last))
        return out

    def _long(self, idx: np.ndarray) -> list[tuple[int, float, int, int]]:
        """The same for one text, piece by piece: what is held does not grow with its length."""
        n = len(self.chains)
        before, least, where = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        best, first, last = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        chains = np.arange(n)
        for lo in range(0, len(idx), AT_ONCE):
            score = self.ratio[idx[lo : lo + AT_ONCE]].astype(np.float64)
            total = before + np.cumsum(score, axis=0)
            prefix = np.minimum.accumulate(np.vstack([least, total - score]), axis=0)[1:]
            gain = total - prefix
            top = gain.argmax(0)
            for k in np.flatnonzero(gain[top, chains] > best):
                t = int(top[k])
                own = (total[: t + 1, k] - score[: t + 1, k]).argmin()
                inside = total[own, k] - score[own, k] < least[k] or lo == 0
                best[k], first[k], last[k] = gain[t, k], lo + own if inside else where[k], lo + t
            low = (total - score).argmin(0)
            less = (total - score)[low, chains] < least
            where[less], least[less] = lo + low[less], (total - score)[low, chains][less]
            before = total[-1]
        return [(int(k), float(best[k]), int(first[k]), int(last[k])) for k in np.flatnonzero(best >= TRY_FROM)]

    def examine_all(self, texts: Sequence[str | None]) -> list[tuple[int, Finding]]:
        """What happened to those of ``texts`` that are not in order, by their places."""
        at = [i for i, t in enumerate(texts) if t and not t.isascii()]
        out = []
        for i, tried in zip(at, self.stretches([texts[i] for i in at])):
            text = texts[i]
            if tried or LOST in text:
                x = self._judge(text, tried)
                if x is not None:
                    out.append((i, self._rest(text, x)))
        return out

    def examine(self, text: str | None) -> Finding | None:
        """What happened to ``text``, or None if it is in order."""
        found = self.examine_all([text])
        return found[0][1] if found else None

    def _judge(self, text: str, tried: list[tuple[float, int, int, int]]) -> Finding | None:
        for score, k, a, z in tried:
            better = self._restore(text, a, z, self.chains[k])
            if better:
                return Finding(self.chains[k], better, score, INVERTED)
        if LOST in text:
            return Finding(self.chains[tried[0][1]] if tried else "", None, tried[0][0] if tried else 0.0, REPLACED)
        for score, k, a, z in tried:
            if score < EVIDENT:
                break
            if self._broken(text[a:z], self.chains[k]):
                return Finding(self.chains[k], None, score, NEARLY)
        return None

    def _rest(self, text: str, found: Finding) -> Finding:
        """``found`` with what else is garbled put right as well."""
        seen = {text}
        while found.restored is not None and found.restored not in seen:
            seen.add(found.restored)
            tried = self.stretches([found.restored])[0]
            again = next((x for s, k, a, z in tried if (x := self._restore(found.restored, a, z, self.chains[k]))), None)
            if again is None:
                break
            found.restored = again
        return found

    def _alike(self, now: str, restored: str, left: str, right: str) -> bool:
        """Whether look-alike letters explain ``now`` better than the restored text does."""
        plain = unicodedata.normalize("NFC", skeleton(now))
        return plain != unicodedata.normalize("NFC", now) and self.succession.likelihood(left + plain + right) >= self.succession.likelihood(restored) - GAIN

    def _broken(self, part: str, chain: str) -> bool:
        """Whether a stretch inverts but for a few characters, which were cut or lost."""
        if _single(chain) or LOST in part:
            return False
        text = part
        for stored, read in reversed(CHAINS[chain]):
            text = decode(encode(text, read, "ignore"), stored, "replace")
        lost = text.count(LOST)
        text = text.replace(LOST, "")
        if lost * 10 > len(text) or not _coherent(text, 0, len(text)):
            return False
        return self.succession.likelihood(text) - self.succession.likelihood(part) > SURE

    def _restore(self, text: str, a: int, z: int, chain: str) -> str | None:
        """``text`` with the chain inverted from about a to about z, if that reads better."""
        lo, hi = _reach(text, a, z, chain)
        lo, hi = max(0, lo - BESIDE), hi + BESIDE
        key = (text[lo:hi], a - lo, z - lo, chain)
        if key not in self._known:
            if len(self._known) >= KNOWN:
                self._known.clear()
            self._known[key] = self._invert(key[0], a - lo, z - lo, chain)
        found = self._known[key]
        return found and text[: lo + found[0]] + found[2] + text[lo + found[1] :]

    def _invert(self, text: str, a: int, z: int, chain: str, accept: Callable[[str, int, int, str, str], bool] | None = None) -> tuple[int, int, str] | None:
        """Where the chain inverts, about from a to z, and what it gives there, if that reads better (or is accepted)."""
        stored, read = CHAINS[chain][-1]
        first, last = _reach(text, a, z, chain)
        if stored == "utf-8" and not _SEQUENCE.search(encode(text[first:last], read, "ignore")):
            return None  # no character that was more than a byte
        tried, accept = set(), accept or self._plausible
        for lo, hi in _ends(text, a, z, chain):
            part = None
            while 2 * (min(hi, z) - max(lo, a)) >= z - a and (lo, hi) not in tried:
                tried.add((lo, hi))
                part, failed = attempt(text[lo:hi], chain)
                if part is not None:
                    break
                if _single(chain):
                    break  # nothing is left out amid a word
                # What does not invert is left out, as long as most of the stretch stays.
                lo, hi = (lo, lo + failed) if failed * 2 >= hi - lo else (lo + failed + 1, hi)
            if part is not None and _single(chain) and (lo, hi) != (first, last) and self._gain(text, lo, hi, part) <= SURE:
                continue  # a rare letter or two of a word
            if part is not None and accept(text, lo, hi, part, chain):
                return lo, hi, part
        return None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _usual(self, text: str, lo: int, hi: int, part: str, chain: str) -> bool:
        """Whether what is restored reads like unharmed text, by itself."""
        return part != text[lo:hi] and self._reads(text, lo, hi, part) >= USUAL

    def _gain(self, text: str, lo: int, hi: int, part: str) -> float:
        left, right = text[max(0, lo - 1) : lo], text[hi : hi + 1]
        return self.succession.likelihood(left + part + right) - self.succession.likelihood(left + text[lo:hi] + right)

    def _reads(self, text: str, lo: int, hi: int, part: str) -> float:
        return self.succession.likelihood(text[max(0, lo - 1) : lo] + part + text[hi : hi + 1]) / (len(part) + 2)

    def _plausible(self, text: str, lo: int, hi: int, part: str, chain: str) -> bool:
        now = text[lo:hi]
        if part == now or LOST in part or not all(map(_written, part)):
            return False
        turned = [(x, y) for x, y in zip(now, part) if x != y] if len(part) == hi - lo else []
        if turned and len(turned) < LEAST_IDEOGRAPHS and CHAINS[chain][-1][1] not in SINGLE_BYTE and all(script_of(y) == "CJK" for _, y in turned):
            return False
        if turned and all(x == CUT for x, _ in turned):
            return False
        if _single(chain) and any(x != y and y.isupper() and b.islower() for b, x, y in zip(text[lo - 1 : lo] + part if lo else " " + part, now, part)):
            return False  # a capital amid a word
        if _REPEATED.search(part):
            return False  # a drawn line is no word of one letter
        if CHAINS[chain][-1][1] not in SINGLE_BYTE and not any(script_of(c) for c in now if c > "\x7f") and all(script_of(c) == "CJK" for c in part if c > "\x7f"):
            return False  # signs alone, such as circled digits, that would be ideographs
        left, right = text[max(0, lo - 1) : lo], text[hi : hi + 1]
        better = self._gain(text, lo, hi, part)
        if better <= GAIN or better <= SURE and not _coherent(left + part + right, len(left), len(left) + len(part), _single(chain)):
            return False
        return self._reads(text, lo, hi, part) >= UNUSUAL and not self._alike(now, left + part + right, left, right)


def _reach(text: str, a: int, z: int, chain: str) -> tuple[int, int]:
    """The stretch from a to z with what belongs to it: whole words for a chain that harms every letter by itself, else its run beyond ASCII."""
    if _single(chain):
        while a and text[a - 1].isalpha():
            a -= 1
        while z < len(text) and text[z].isalpha():
            z += 1
        return a, z
    first, last = a, z
    while first and text[first - 1] > "\x7f" and a - first < WIDER:
        first -= 1
    while last < len(text) and text[last] > "\x7f" and last - z < WIDER:
        last += 1
    return first, last


def _ends(text: str, a: int, z: int, chain: str) -> list[tuple[int, int]]:
    """Places at which the stretch from a to z may begin and end, likeliest first."""
    first, last = _reach(text, a, z, chain)
    if _single(chain):  # whole words, else from or to a letter amid one; the outermost may be an unharmed one
        if (first, last) == (a, z) or z - a < LEAST_AMID:
            return [(first, last)]
        return list(dict.fromkeys([(first, last), *((x, y) for x in (a, a + 1, first) for y in (z, z - 1, last))]))
    tried = [(first, last), (a, z)]
    if CHAINS[chain][0][0] != "utf-8":  # only UTF-8 tells where a character begins
        tried += [(a, last), (a + 1, last), (a - 1, last), (a + 2, last), (a - 2, last), (a, z + 1)]
    return list(dict.fromkeys((x, y) for x, y in tried if 0 <= x < y <= len(text)))


_REPEATED = re.compile(r"(?<!\w)([^\W\d_\x00-\x7f\u2e80-\uffff])\1+(?!\w)")
#: A character of several bytes in UTF-8.
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Characters by which a stretch is widened within a run beyond ASCII; how many beside that can matter: two by which it may begin earlier, one to read on from.
WIDER, BESIDE = 8, 3
#: Stretches that are kept with what came out, since words come again and again.
KNOWN = 1 << 16

ALPHABETS = {"LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC"}


def _coherent(text: str, a: int, z: int, letters: bool = False) -> bool:
    """Most of the letters beyond ASCII from a to z stand beside a letter of their own script; ``letters``: there has to be one."""
    scripts = [script_of(c) for c in text]
    if any(x != y and x and y and {x, y} <= ALPHABETS for x, y in zip(scripts[max(0, a - 1) : z], scripts[max(1, a) : z + 1])):
        return False  # two alphabets in one word
    foreign = [i for i in range(a, z) if scripts[i] and ord(text[i]) > 127]
    beside = sum(i > 0 and scripts[i - 1] == scripts[i] or i + 1 < len(text) and scripts[i + 1] == scripts[i] for i in foreign)
    return beside * 2 > len(foreign) or not foreign and not letters


def fit(records: DataFrame) -> EncodingModel:
    """A model of all records, whatever their number and length; equal texts count once.

    Plain ASCII can't be garbled, and what was lost can't be counted: such records take no part. Counts
    are made where the records lie; the driver gets their sums, at most a bucket's for every chain
    and one for every two characters that follow one another somewhere.
    """
    usable = records.where(F.col("text").rlike(r"[^\x00-\x7F]") & ~F.col("text").contains(LOST)).select("text").distinct()
    rows = usable.select("text", F.lit(False).alias("doubtful"), F.lit(False).alias("harmed"), F.lit(b"").alias("tried"))
    return EncodingModel.of(InTable(materialize(rows, "garbled")))


def find_garbled(records: DataFrame, model: EncodingModel | None = None) -> DataFrame:
    """``field``, ``rec_id``, ``chain``, ``restored``, ``evidence`` of the garbled ones among ``records`` (field, rec_id, text).

    ``restored`` is the whole text with the garbled stretches put right, null where that can't be
    done. ``evidence``: ``inverted`` (strictly, both ways), ``nearly`` (but for a few characters) or
    ``replaced`` (replacement characters stand where others were; ``chain`` is then the likeliest, or
    empty). Null, empty and plain ASCII texts are in order; repeated rows count once; an empty table
    gives no rows. Texts of any length are examined whole. Of the texts only restored ones are shuffled.
    """
    kind = records.schema["rec_id"].dataType.simpleString()
    return _examined(records, model, f"field string, rec_id {kind}, chain string, restored string, evidence string").distinct()


def garbled_ids(records: DataFrame, model: EncodingModel | None = None) -> DataFrame:
    """``field``, ``rec_id`` of the garbled records; no text is shuffled."""
    kind = records.schema["rec_id"].dataType.simpleString()
    return _examined(records, model, f"field string, rec_id {kind}").distinct()


def _examined(records: DataFrame, model: EncodingModel | None, schema: str) -> DataFrame:
    if model is None:
        model = fit(records)
    shared = records.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lo = 0
            for part in portions(b.column(2), 2048):
                found = m.examine_all(part.to_pylist())
                at = pa.array([lo + i for i, _ in found], pa.int64())
                columns = [b.column(0).take(at), b.column(1).take(at), *(pa.array([getattr(x, c) for _, x in found], pa.string()) for c in names[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                lo += len(part)

    usable = records.select("field", "rec_id", "text").where("text IS NOT NULL AND text <> ''")
    return spread(usable).mapInArrow(run, schema)
