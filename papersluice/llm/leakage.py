"""Evaluation texts that leaked into a corpus.

Latent semantic retrieval: documents and passages are cut into windows of terms, weighted by
TF-IDF (document frequencies over the whole corpus) and projected onto the leading singular
directions of a term matrix, which a distributed randomised SVD finds. A window whose cosine with
a passage is high enough makes the document a candidate for that passage. Candidates are then
checked term by term: the longest common subsequence of the passage's sentences with the document
counts, within a stretch of the document, by the weight of the terms that set this passage apart
from the other passages and from the corpus, so the same manner of writing, stock questions and a
few words in common weigh nothing. Before all this, documents are left out that have too few of a
passage's terms, in whatever order, for any subsequence to weigh enough.
"""

from __future__ import annotations

import math
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersluice.llm.lookalike import skeleton
from papersluice.llm.terms import chars, mixed, portions, term_hashes, terms
from papersluice.session import materialize, spread

#: Hash buckets of terms.
BUCKETS = 1 << 15
#: Singular directions, and how many more the random projection starts with.
RANK, OVERSAMPLING, POWER_STEPS = 48, 16, 2
#: Documents from which the directions are fitted, beside all passages.
FIT_DOCUMENTS = 3000
#: Terms of a block; a window is two blocks, and begins at every block.
BLOCK = 16
#: Cosine from which a window makes its document a candidate.
COSINE = 0.0
#: Share of a passage's distinctive weight that a leak holds.
HELD = 0.28
#: Share from which a leak counts if it also holds the item's answer.
HELD_WITH_ANSWER = 0.24
#: A term is distinctive if at most this share of the passages have it (but 2 may always).
DISTINCTIVE = 0.02
#: ... and at most this share of the corpus.
RARE = 0.01
#: Share of the terms of two passages that are the same from which they count as one, when DISTINCTIVE is judged.
COPY = 0.5
#: Passages of different kinds that may have a term by which copies are looked up.
LOOKED_UP = 100
#: Share of a passage's distinctive terms from which a stretch of a document counts as a part of it, not as corpus, when RARE is judged.
PART = 0.2
#: Pairs of a term's occurrence and a passage that are looked at at once.
PAIRS_AT_ONCE = 1 << 21
#: Rarer than this makes no difference.
RAREST = 0.0001
#: Length of the stretch of a document in which a passage is looked for, in passage lengths.
STRETCH = 2.5
#: Passages searched for in one pass over the corpus: what a task holds of them is bounded by it.
PASSAGES_AT_ONCE = 5_000
#: Characters on each side of a line break that tokens() joins.
JOINED = 40
#: Cosines computed at once.
COSINES_AT_ONCE = 1 << 22
#: Items and characters of passages that are taken as a query set; it is collected, so more are refused.
MOST_ITEMS, MOST_CHARS = 200_000, 200_000_000
#: Parts in which the partial products (terms x few numbers) are added up.
PIECES = 8


# --- projection ------------------------------------------------------------------------------


def blocks(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of BLOCK terms of each text, and the text of each block."""
    sizes = np.diff(bounds)
    n = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bounds[:-1][owner] + within * BLOCK, owner


def project(ids: np.ndarray, bounds: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all windows, and the text of each; ``directions`` includes the IDF weights."""
    start, owner = blocks(ids, bounds)
    if not len(start):
        return np.zeros((0, directions.shape[1]), np.float32), owner
    sums = np.empty((len(start), directions.shape[1]), np.float32)
    step = 4096
    for lo in range(0, len(start), step):
        hi = min(lo + step, len(start))
        last = start[hi] if hi < len(start) else len(ids)
        sums[lo:hi] = np.add.reduceat(directions[ids[start[lo] : last]], start[lo:hi] - start[lo], axis=0)
    joined = np.flatnonzero(owner[:-1] == owner[1:])
    alone = np.setdiff1d(np.arange(len(start)), np.concatenate([joined, joined + 1]), assume_unique=False)
    vectors = np.concatenate([sums[joined] + sums[joined + 1], sums[alone]])
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return vectors / np.maximum(norm, 1e-9), np.concatenate([owner[joined], owner[alone]])


@dataclass
class Owners:
    """Which passages each watched term is distinctive for: term t has the pairs start[t] to start[t + 1], pair k is with ``passage[k]``."""

    start: np.ndarray
    passage: np.ndarray
    need: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, own: Sequence[set[str]], length: Sequence[int], texts: Sequence[str], watched: np.ndarray) -> Owners:
        """``own``: distinctive terms of each of the passages ``texts``, ``length``: its terms."""
        listed: list[list[int]] = [[] for _ in watched]
        for i, t in enumerate(texts):
            hashes, keys = term_keys([t])
            for at, ks in zip(np.searchsorted(watched, hashes), keys):
                if not own[i].isdisjoint(ks):
                    listed[at].append(i)
        passage = np.array([i for x in listed for i in x], np.int64)
        size = np.bincount(passage, minlength=len(own))
        half = np.array([math.ceil(STRETCH * n / 2) for n in length], np.int64)
        return cls(np.cumsum([0, *map(len, listed)]), passage, np.maximum(2, np.ceil(PART * size)).astype(np.int64), np.maximum(1, half))

    def parts(self, owner: np.ndarray, at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the occurrences of watched terms in documents (document, place in it, term; by document): the pairs in stretches that
        hold a part of their passage, once a document, and the passages of which a document holds a part, once a document."""
        n = self.start[term + 1] - self.start[term]
        total = np.cumsum(n)
        pairs, held = [], []
        lo = 0
        while lo < len(term):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right"))
            first = int(np.searchsorted(owner, owner[min(hi, len(owner) - 1)])) if hi < len(owner) else len(owner)
            hi = first if first > lo else int(np.searchsorted(owner, owner[lo], "right"))
            many = n[lo:hi]
            k = np.repeat(self.start[term[lo:hi]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            doc, place = np.repeat(owner[lo:hi], many), np.repeat(at[lo:hi], many)
            lo = hi
            both = doc * len(self.need) + self.passage[k]  # few documents have enough of a passage's terms at all
            one, back, times = np.unique(both, return_inverse=True, return_counts=True)
            enough = (times >= self.need[one % len(self.need)])[back]
            doc, place, k, both = doc[enough], place[enough], k[enough], both[enough]
            if not len(k):
                continue
            _, both = np.unique(both, return_inverse=True)
            window = place // self.half[self.passage[k]]
            wide = int(window.max()) + 2
            stretch = np.concatenate([both * wide + window + 1, both * wide + window])  # each half is in two stretches
            twice = np.concatenate([k, k])
            _, stretch = np.unique(stretch, return_inverse=True)
            distinct = np.unique(stretch * len(self.passage) + twice)
            times = np.bincount(distinct // len(self.passage), minlength=stretch.max() + 1)
            whole = times[stretch] >= self.need[self.passage[twice]]
            doc, twice = np.concatenate([doc, doc])[whole], twice[whole]
            pairs.append(np.unique(doc * len(self.passage) + twice) % len(self.passage))
            held.append(np.unique(doc * len(self.need) + self.passage[twice]) % len(self.need))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *pairs]), np.concatenate([none, *held])


def document_frequency(texts: DataFrame, watched: np.ndarray, owners: Owners) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """In how many texts each bucket of terms occurs, and each of the ``watched`` terms (sorted 64-bit hashes); in how many each
    pair of ``owners`` occurs within a part of its passage, and how many hold a part of each passage; the number of texts. Over all rows.

    Each partition counts into arrays of fixed size, so what is shuffled is bounded by their size x partitions.
    """
    shared = texts.sparkSession.sparkContext.broadcast((watched, owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        watched, owners = shared.value
        within, holding = np.zeros(len(owners.passage), np.int64), np.zeros(len(owners.need), np.int64)
        maybe = np.zeros(1 << 20, bool)
        maybe[(watched >> np.uint64(44)).astype(np.int64)] = True
        count, exact, n = np.zeros(BUCKETS, np.int64), np.zeros(len(watched) + 1, np.int64), 0
        for b in batches:
            for part in (x.to_pylist() for x in portions(b.column(0), 1024)):
                hashes, bounds = term_hashes(chars(part))
                owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                seen = np.zeros((len(part), BUCKETS), bool)
                seen[owner, (hashes % np.uint64(BUCKETS)).astype(np.int64)] = True
                count += seen.sum(0)
                n += len(part)
                few = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
                place = np.searchsorted(watched, hashes[few])
                hit = (place < len(watched)) & (watched[np.minimum(place, len(watched) - 1)] == hashes[few])
                exact += np.bincount(np.unique(owner[few][hit] * (len(watched) + 1) + place[hit]) % (len(watched) + 1), minlength=len(watched) + 1)
                few, place = few[hit], place[hit]
                pairs, held = owners.parts(owner[few], few - bounds[owner[few]], place)
                within += np.bincount(pairs, minlength=len(within))
                holding += np.bincount(held, minlength=len(holding))
        counts = np.concatenate([count, exact[:-1], within, holding])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], names=["term", "n"])

    rows = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    total = int(rows.n[rows.term == -1].sum())
    ends = np.cumsum([BUCKETS, len(watched), len(owners.passage), len(owners.need)])
    counts = np.zeros(ends[-1], np.float64)
    rows = rows[rows.term >= 0]
    counts[rows.term] = rows.n
    return *np.split(counts, ends[:-1]), total


def randomised_svd(texts: DataFrame, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors (terms x RANK) of the unit TF-IDF windows of ``texts``, each over its singular value.

    The division keeps the directions that all texts of a language share from ruling the cosine.

    A random matrix is multiplied by A'A in every partition of A; the partial products are added
    up by Spark, term range by term range; between the steps the driver orthonormalises (terms x
    few) numbers, whose size does not depend on the data.
    """
    width = RANK + OVERSAMPLING
    basis = np.random.default_rng(seed).standard_normal((BUCKETS, width)).astype(np.float32)
    spark, pieces = texts.sparkSession, PIECES

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = shared.value
            out = np.zeros_like(x)
            for b in batches:
                for part in portions(b.column(0), 256):
                    ids, bounds = terms(chars(part.to_pylist()), BUCKETS)
                    start, _ = blocks(ids, bounds)
                    if not len(start):
                        continue
                    size = np.diff(np.append(start, len(ids)))
                    row = np.repeat(np.arange(len(start)), size)
                    weight = idf[ids].astype(np.float32)
                    norm = np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2, len(start)))
                    weight /= np.maximum(norm, 1e-9)[row]
                    left = np.add.reduceat(x[ids] * weight[:, None], start, axis=0)
                    np.add.at(out, ids, left[row] * weight[:, None])
            parts = np.array_split(out, pieces)
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces)), pa.array([p.tobytes() for p in parts])], names=["piece", "sums"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(s, np.float32).astype(np.float64) for s in pdf["sums"])
            return pd.DataFrame({"piece": pdf["piece"][:1], "sums": [np.float32(total).tobytes()]})

        rows = texts.mapInArrow(run, "piece long, sums binary").groupBy("piece").applyInPandas(add, "piece long, sums binary").collect()
        shared.destroy()
        return np.concatenate([np.frombuffer(r.sums, np.float32).reshape(-1, width) for r in sorted(rows, key=lambda r: r.piece)])

    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    image = product(basis)  # A'A Q: its Gram matrix with Q gives the squared singular values
    values, vectors = np.linalg.eigh((basis.T @ image).astype(np.float64))
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    return np.ascontiguousarray(basis @ (vectors / np.sqrt(np.maximum(values, 1e-6 * max(values[0], 1e-12))))).astype(np.float32)


# --- check -----------------------------------------------------------------------------------

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_HAN = regex.compile(r"[぀-ヿ㐀-鿿가-힣豈-﫿]+")
_SENTENCE = regex.compile(r"(?<=[.!?。！？;；])\s*")
_BREAK = regex.compile(r"\p{Zs}*[\r\n]+[\p{Zs}>|*•\t]*")


def _keys(w: str) -> tuple[str, ...]:
    if w.isascii():
        return ("".join(sorted(w)),)
    out, last = [], 0
    for h in _HAN.finditer(w):
        if h.start() > last:
            out.append("".join(sorted(w[last : h.start()])))
        run = h.group()
        out.extend(run[i : i + 2] for i in range(len(run) - 1))
        last = h.end()
    if last < len(w):
        out.append("".join(sorted(w[last:])))
    return tuple(out)


#: Words come again and again; those too long to be kept are few.
_known_keys = lru_cache(1 << 16)(_keys)


def tokens(text: str) -> list[str]:
    """Words as keys that don't see the order of their inner letters, and pairs of ideographs, in order.

    A word that a line break may have cut comes also whole.
    """
    text = skeleton(text).lower()
    out: list[str] = []

    def add(part: str) -> None:
        for w in _TOKEN.findall(part):
            out.extend(_known_keys(w) if len(w) <= 40 else _keys(w))

    last = 0
    for m in _BREAK.finditer(text):
        add(text[last : m.start()])
        last = m.end()
        if not m.start() or not _TOKEN.match(text, m.start() - 1):
            continue
        a = regex.search(r"[\p{L}\p{M}\p{N}]*$", text[max(0, m.start() - JOINED) : m.start()]).group()
        z = _TOKEN.match(text[m.end() : m.end() + JOINED])
        if a and z:
            add(_HAN.split(a)[-1] + _HAN.split(z.group())[0] if not (_HAN.match(a[-1]) or _HAN.match(z.group()[0])) else a[-1] + z.group()[0])
    add(text[last:])
    return out


#: Kinds of characters as tokens() tells them apart.
GAP, LETTER, HAN, LINE = 0, 1, 2, 3
#: Marks that _HAN takes in (as of kana): beside other marks, normalization may change their place.
_HAN_MARKS = np.array([c for c in range(0x3040, 0xFB00) if unicodedata.combining(chr(c)) and _HAN.match(chr(c))], np.uint32)
_UNKNOWN = 255


class Folds:
    """What skeleton() and lower() make of each code point by itself, learnt when it is first met.

    Of a text they make the same, but for the order of marks and the two small sigmas, which count as one here.
    """

    def __init__(self) -> None:
        self.size = np.full(0x110000, _UNKNOWN, np.uint8)
        self.start = np.zeros(0x110000, np.int32)
        self.codes = np.zeros(0, np.uint32)
        self.kinds = np.zeros(0, np.uint8)
        self.values = np.zeros(0, np.uint64)

    def _learn(self, points: np.ndarray) -> None:
        codes, kinds = [], []
        for cp in points.tolist():
            made = skeleton(chr(cp)).lower().replace("ς", "σ")
            self.size[cp], self.start[cp] = len(made), len(self.codes) + len(codes)
            codes += map(ord, made)
            kinds += (LINE if c in "\r\n" else GAP if not _TOKEN.match(c) else HAN if _HAN.match(c) else LETTER for c in made)
        self.codes = np.concatenate([self.codes, np.array(codes, np.uint32)])
        self.kinds = np.concatenate([self.kinds, np.array(kinds, np.uint8)])
        self.values = _letter_values(self.codes)

    def of(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where ``codes``, ``kinds`` and ``values`` have each character of ``texts``, a gap after each text; where each text begins (and the last ends)."""
        raw = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        size = self.size[raw]
        if (new := size == _UNKNOWN).any():
            self._learn(np.unique(raw[new]))
            size = self.size[raw]
        at = self.start[raw]
        if (size != 1).any():
            ends = np.cumsum(size, dtype=np.int64)
            at = np.repeat(at, size)
            for k in range(1, int(size.max())):
                more = np.flatnonzero(size > k)
                at[ends[more] - size[more] + k] += k
            bounds = np.concatenate([[0], ends[bounds[1:] - 1]])
        return at, bounds


_folds = lru_cache(1)(Folds)


def _letter_values(codes: np.ndarray) -> np.ndarray:
    """64 bits for each letter; a word's hash is their sum, which does not see the order of its letters."""
    return mixed(codes.astype(np.uint64) + np.uint64(1))


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed((first.astype(np.uint64) << np.uint64(32)) + second.astype(np.uint64))


def key_hashes(keys: Sequence[str]) -> np.ndarray:
    """64-bit hashes of keys as tokens() gives them."""
    codes = np.frombuffer("".join(keys).replace("ς", "σ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0, *map(len, keys)])
    sums = _sums(_letter_values(codes))
    out = sums[ends[1:]] - sums[ends[:-1]]
    han = np.array([k for k, w in enumerate(keys) if _HAN.match(w)], np.int64)
    out[han] = _pair_hashes(codes[ends[han]], codes[ends[han] + 1])
    return out


def text_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all keys of more than one character that tokens() finds in the texts, the place of each, the places where each text
    begins (and the last ends), and the numbers of the texts of which this can't be said.

    There may be more: whatever is on both sides of a line break is joined.
    """
    folds = _folds()
    place, bounds = folds.of(texts)
    kinds = folds.kinds[place]
    letter = kinds == LETTER
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = _sums(folds.values[place])
    words = sums[end] - sums[start]
    han, lines = np.flatnonzero(kinds == HAN), np.flatnonzero(kinds == LINE)
    first = np.flatnonzero(np.diff(han) == 1)
    parted = _around(han, lines)
    beside = np.concatenate([first, parted])
    joined = _around(start, lines)
    hashes = np.concatenate([words, words[joined] + words[joined + 1], _pair_hashes(folds.codes[place[han[beside]]], folds.codes[place[han[beside + 1]]])])
    size = end - start
    long = start[joined][np.maximum(size[joined], size[joined + 1]) > JOINED]
    marked = [p for p in han[np.isin(folds.codes[place[han]], _HAN_MARKS)].tolist() if any(unicodedata.combining(chr(c)) for c in folds.codes[place[[max(0, p - 1), min(p + 1, len(place) - 1)]]])]
    return hashes, np.concatenate([start, start[joined], han[beside]]), bounds, np.unique(np.searchsorted(bounds, np.concatenate([long, np.array(marked, np.int64)]), "right") - 1)


def _around(at: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Numbers of the places ``at`` that are the last before one of the ``lines``, if another place follows."""
    before = np.unique(np.searchsorted(at, lines)) - 1
    return before[(before >= 0) & (before < len(at) - 1)]


def split_tokens(passage: str) -> list[list[str]]:
    return [tokens(s) for s in _SENTENCE.split(passage) if s]


def copies(known: Sequence[set[str]]) -> list[int]:
    """For each passage (set of terms) the number of its group; passages that share at least COPY of their terms with the group's first are one.

    A copy shares its group's rare terms; those that many groups have are not looked up.
    """
    groups: dict[frozenset, int] = {}
    first: list[set[str]] = []
    having: defaultdict[str, list[int]] = defaultdict(list)
    out = []
    for p in known:
        g = groups.get(frozenset(p))
        if g is None:
            votes = Counter(x for w in p if len(having[w]) <= LOOKED_UP for x in having[w])
            g = next((x for x in votes if len(p & first[x]) >= COPY * len(p | first[x])), None)
            if g is None:
                g = len(first)
                first.append(p)
                for w in p:
                    having[w].append(g)
            groups[frozenset(p)] = g
        out.append(g)
    return out


def distinctive(split: Sequence[list[list[str]]]) -> list[set[str]]:
    """The terms of each passage (sentences of terms) that few of all passages have; copies of a passage are one."""
    known = [{w for s in p for w in s} for p in split]
    groups = copies(known)
    count = Counter(w for _, w in {(g, w) for g, p in zip(groups, known) for w in p})
    most = max(2, DISTINCTIVE * (max(groups, default=0) + 1))
    return [{w for w in p if count[w] <= most and len(w) > 1} for p in known]


def shares(own: Sequence[set[str]], owners: Owners, keys: Sequence[Sequence[str]], exact: np.ndarray, within: np.ndarray, holding: np.ndarray, n: int) -> list[dict[str, float]]:
    """For each passage, the share of the documents that has each of its terms elsewhere than in a part of it."""
    out: list[dict[str, float]] = [{} for _ in own]
    for t, ks in enumerate(keys):
        for k in range(owners.start[t], owners.start[t + 1]):
            i = int(owners.passage[k])
            rest = float(exact[t] - within[k]) / max(1.0, n - holding[i])
            for w in ks:
                if w in own[i]:
                    out[i][w] = max(rest, out[i].get(w, 0.0))
    return out


@dataclass
class Passages:
    """Test passages, ready to be checked against documents."""

    ids: list
    sentences: list[list[list[str]]] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    answers: list[set[str]] = field(default_factory=list)
    weights: list[dict[str, float]] = field(default_factory=list)
    having: dict[str, list[int]] = field(default_factory=dict)
    length: list[int] = field(default_factory=list)
    #: Hashes of the terms; hash h has the pairs pairs[0][h] to pairs[0][h + 1]: passage pairs[1][k], which has pairs[2][k] of weight by it.
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, ids: Sequence, split: Sequence[list[list[str]]], answers: Sequence[str | None], own: Sequence[set[str]], share: Sequence[dict[str, float]]) -> Passages:
        """``split``: sentences of terms. ``own``: distinctive terms of each passage. ``share``: of the corpus, without what holds a part of the passage, that has each of them."""
        self = cls(list(ids))
        having, number, term, mass = defaultdict(list), {}, array("q"), array("d")
        for i, (p, answer) in enumerate(zip(split, answers)):
            self.length.append(sum(map(len, p)))
            # A passage that leaked often in parts too small to be told makes all its terms frequent alike: that much says nothing about a term.
            leaked = float(np.percentile([share[i].get(w, 0.0) for w in own[i]], 25)) if own[i] else 0.0
            weight = {w: math.log(RARE / max(rest, RAREST)) for w in own[i] if (rest := share[i].get(w, 0.0) - leaked) < RARE}
            p = [[w for w in s if w in weight] for s in p]
            self.weights.append(weight)
            self.sentences.append(p)
            self.total.append(sum(weight[w] for s in p for w in s))
            self.answers.append(set(tokens(answer)) if answer else set())
            times = Counter(w for s in p for w in s)
            for w in weight:
                having[w].append(i)
                term.append(number.setdefault(w, len(number)))
                mass.append(times[w] * weight[w])
        self.having = dict(having)
        self.hashes, of_term = np.unique(key_hashes(list(number)), return_inverse=True)
        of_pair = of_term[np.array(term, np.int64)]
        order = np.argsort(of_pair, kind="stable")
        passage = np.repeat(np.arange(len(self.weights)), [len(x) for x in self.weights])
        self.pairs = np.searchsorted(of_pair[order], np.arange(len(self.hashes) + 1)), passage[order], np.array(mass)[order]
        return self

    def possible(self, texts: Sequence[str]) -> np.ndarray:
        """Numbers of the texts that may hold a passage: the others have too few of its terms, in whatever order, for any subsequence to weigh enough."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        hashes, at, bounds, unsure = text_hashes(texts)
        # Most terms are no passage's: a table of their first bits says so of nearly all.
        few = np.flatnonzero(self._maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[few])
        hit = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[few]
        owner = np.searchsorted(bounds, at[few[hit]], "right") - 1
        doc, term = np.divmod(np.unique(owner * len(self.hashes) + place[hit]), len(self.hashes))
        start, passage, weight = self.pairs
        need = np.array([t * (HELD_WITH_ANSWER if a else HELD) for t, a in zip(self.total, self.answers)])
        n = start[term + 1] - start[term]
        reached = np.cumsum(n)
        out, lo = [unsure], 0
        while lo < len(doc):
            hi = int(np.searchsorted(reached, (reached[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right"))
            whole = int(np.searchsorted(doc, doc[hi])) if hi < len(doc) else hi  # a text's terms stay together
            hi = whole if whole > lo else int(np.searchsorted(doc, doc[lo], "right"))
            many = n[lo:hi]
            k = np.repeat(start[term[lo:hi]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both, back = np.unique(np.repeat(doc[lo:hi], many) * len(need) + passage[k], return_inverse=True)
            enough = np.bincount(back, weight[k], len(both)) * (1 + 1e-9) >= need[both % len(need)]  # sums in another order may be less by a little
            out.append(both[enough] // len(need))
            lo = hi
        return np.unique(np.concatenate(out))

    @cached_property
    def _maybe(self) -> np.ndarray:
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        return maybe

    def held(self, text: str, candidates: np.ndarray | None = None) -> list[tuple[int, float]]:
        """Passages that ``text`` holds (their numbers, and the share held); ``candidates``: which may."""
        every = tokens(text)
        doc = [(at, w) for at, w in enumerate(every) if w in self.having]
        weight: defaultdict[int, float] = defaultdict(float)
        for w in {w for _, w in doc}:
            for i in self.having[w]:
                weight[i] += self.weights[i][w]
        out = []
        for i, bound in weight.items():
            # The weight of terms in common bounds the subsequence from above, but for terms that a passage repeats.
            if candidates is not None and not candidates[i] or bound < HELD_WITH_ANSWER * self.total[i] / 2:
                continue
            own = self.weights[i]
            stretch = self._stretch(own, [x for x in doc if x[1] in own], int(STRETCH * self.length[i]))
            share = self.share(i, [w for _, w in stretch])
            if share >= HELD or share >= HELD_WITH_ANSWER and self.answers[i] and self.answers[i] <= set(every[stretch[0][0] : stretch[-1][0] + 1]):
                out.append((i, share))
        return out

    @staticmethod
    def _stretch(weight: dict[str, float], matches: list[tuple[int, str]], length: int) -> list[tuple[int, str]]:
        """Of the matching terms (by place), those of the stretch of ``length`` with the most weight; a repeated term counts once."""
        best, got, lo, inside = (0.0, 0, 0), 0.0, 0, Counter()
        for hi, (at, w) in enumerate(matches):
            inside[w] += 1
            got += weight[w] * (inside[w] == 1)
            while at - matches[lo][0] > length:
                gone = matches[lo][1]
                inside[gone] -= 1
                got -= weight[gone] * (inside[gone] == 0)
                lo += 1
            best = max(best, (got, lo, hi + 1))
        return matches[best[1] : best[2]]

    def share(self, i: int, doc: list[str]) -> float:
        """Weight of the sentences' longest common subsequences with ``doc``, as a share of the passage's."""
        got = 0.0
        for s in self.sentences[i]:
            vocabulary = set(s)
            got += _lcs(s, [w for w in doc if w in vocabulary], self.weights[i])
        return got / self.total[i]


def term_keys(texts: Sequence[str]) -> tuple[np.ndarray, list[list[str]]]:
    """Sorted 64-bit hashes of all terms of ``texts``, and for each the keys by which tokens() knows it."""
    words: dict[str, str] = {}
    for t in texts:
        for m in _TOKEN.finditer(skeleton(t).lower()):
            for w in _HAN.split(m.group()):
                if w:
                    words[w] = "".join(sorted(w))
            for run in _HAN.findall(m.group()):
                words.update((run[i : i + 2], run[i : i + 2]) for i in range(len(run) - 1))
    listed = list(words)
    hashes, bounds = term_hashes(chars(listed))
    keys: defaultdict[int, set[str]] = defaultdict(set)
    for w, lo, hi in zip(listed, bounds, bounds[1:]):
        if hi - lo == 1:
            keys[int(hashes[lo])].add(words[w])
    order = sorted(keys)
    return np.array(order, np.uint64), [sorted(keys[h]) for h in order]


def _lcs(a: list[str], b: list[str], weight: dict[str, float]) -> float:
    row = [0.0] * (len(b) + 1)
    for x in a:
        diagonal = 0.0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = diagonal + weight[x] if x == y else max(up, row[j - 1])
            diagonal = up
    return row[-1]


# --- search ----------------------------------------------------------------------------------


def find_leaks(docs: DataFrame, items: DataFrame, cosine: float | None = None) -> DataFrame:
    """``item_id``, ``doc_id`` of documents that hold an item's passage, whole or about two fifths of it or more.

    ``docs``: doc_id, text; ``items``: item_id, passage, answer (which may be null). Null and empty
    texts and passages match nothing; a passage of many items is found for each of them; an item whose
    passage has no distinctive term matches nothing; repeated rows count once; empty tables give no
    rows. Texts of any length are searched whole, every document is searched, and a document may
    hold any number of passages. ``cosine`` of -1 makes every document a candidate for all items.

    The items are a query set: they are collected (at most MOST_ITEMS with MOST_CHARS, else ValueError),
    and searched for in rounds of PASSAGES_AT_ONCE, each of which reads the corpus once. Documents are
    not shuffled (but a corpus in few files is spread over the cores first).
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item_type}, doc_id {doc_type}"
    least = COSINE if cosine is None else cosine
    wanted = items.select("item_id", "passage", "answer").where("item_id IS NOT NULL AND passage IS NOT NULL AND passage <> ''").dropDuplicates(["item_id", "passage"])
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars")).first()
    if size.n > MOST_ITEMS or size.chars > MOST_CHARS:
        raise ValueError(f"{size.n} items with {size.chars} characters are more than a query set may have ({MOST_ITEMS}, {MOST_CHARS}): search for them in parts")
    wanted = wanted.orderBy("item_id", "passage").toPandas()
    corpus = spread(docs.select("doc_id", "text").where("text IS NOT NULL AND text <> ''"))
    if wanted.empty:
        return spark.createDataFrame([], schema)

    watched, keys = term_keys(wanted.passage.tolist())
    split = [split_tokens(t) for t in wanted.passage]
    own = distinctive(split)
    owners = Owners.of(own, [sum(map(len, p)) for p in split], wanted.passage.tolist(), watched)
    df, exact, within, holding, n = document_frequency(corpus.select("text"), watched, owners)
    share_of = shares(own, owners, keys, exact, within, holding, n)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    share = max(1, n // FIT_DOCUMENTS)
    sample = corpus.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    basis = randomised_svd(materialize(sample.union(wanted_frame(items)).repartition(spark.sparkContext.defaultParallelism), "svd-fit"), idf)
    directions = np.ascontiguousarray(basis * idf[:, None])

    found = None
    for at in range(0, len(wanted), PASSAGES_AT_ONCE):
        part = wanted.iloc[at : at + PASSAGES_AT_ONCE]
        passages = Passages.of(part.item_id.tolist(), split[at : at + PASSAGES_AT_ONCE], [a if isinstance(a, str) else None for a in part.answer], own[at : at + PASSAGES_AT_ONCE], share_of[at : at + PASSAGES_AT_ONCE])
        ids, bounds = terms(chars(part.passage.tolist()), BUCKETS)
        vectors, owner = project(ids, bounds, directions)
        query = np.zeros((len(part), RANK), np.float32)
        np.add.at(query, owner, vectors)
        query /= np.maximum(np.sqrt((query * query).sum(1, keepdims=True)), 1e-9)
        shared = spark.sparkContext.broadcast((passages, query, directions))
        hits = corpus.mapInArrow(_search(shared, least, item_type), schema)
        found = hits if found is None else found.union(hits)
    return found.distinct()


def wanted_frame(items: DataFrame) -> DataFrame:
    return items.where("passage IS NOT NULL AND passage <> ''").select(F.col("passage").alias("text"))


def _search(shared, least: float, item_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, query, directions = shared.value
        numbers = pa.array(passages.ids)
        for b in batches:
            item_at, doc_at, lo = [], [], 0
            for texts in (x.to_pylist() for x in portions(b.column(1), 512)):
                some = passages.possible(texts).tolist()
                for k, near in _near([texts[k] for k in some], query, directions, least).items():
                    for i, _ in passages.held(texts[some[k]], near):
                        item_at.append(i)
                        doc_at.append(lo + some[k])
                lo += len(texts)
            yield pa.RecordBatch.from_arrays([numbers.take(pa.array(item_at, pa.int64())), b.column(0).take(pa.array(doc_at, pa.int64()))], names=["item_id", "doc_id"])

    return run


def _near(texts: list[str], query: np.ndarray, directions: np.ndarray, least: float) -> dict[int, np.ndarray]:
    """For each text with a window near some passage: which passages it is near to."""
    if least <= -1:
        return dict.fromkeys(range(len(texts)), np.ones(len(query), bool))
    ids, bounds = terms(chars(texts), BUCKETS)
    vectors, owner = project(ids, bounds, directions)
    order = np.argsort(owner, kind="stable")
    vectors, owner = vectors[order], owner[order]
    out: dict[int, np.ndarray] = {}
    step = max(64, COSINES_AT_ONCE // max(1, len(query)))
    for lo in range(0, len(vectors), step):
        of = owner[lo : lo + step]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        near = np.maximum.reduceat(vectors[lo : lo + step] @ query.T, first, axis=0) >= least
        for doc, row in zip(of[first].tolist(), near):
            if row.any():
                out[doc] = out[doc] | row if doc in out else row
    return out
