"""Abusive, hateful or sexual content: a score for every document.

A linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio, fitted
on labelled documents. One sentence makes a document abusive, so the unit is the sentence and a
document's score is that of its worst one. Labels are of documents: the fit starts from all
sentences of bad documents against those of good ones and then keeps, round by round, the
sentences that the last round found bad. Disguised spelling (look-alike letters, digits for
letters, letters set apart or drawn out, invisible characters) is undone before n-grams are taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersluice.llm.terms import IDEOGRAPH, WORD, chars, portions
from papersluice.session import spread

#: Labelled documents from which the classifier is fitted, and the length (code points) up to which one is drawn: what reaches the driver is bounded by both.
FIT_DOCUMENTS, FIT_CHARS = 4000, 50_000
#: Texts that are cut into sentences at once.
AT_ONCE = 512
#: Hash buckets of n-grams, and their lengths.
BUCKETS = 1 << 18
ORDERS = (1, 2, 3, 4, 5)
#: Rounds of choosing sentences, steps of the fit in each, and its settings.
ROUNDS, STEPS, RATE, PENALTY = 4, 40, 0.1, 1e-5
SMOOTHING = 2.0
#: Weight of a chosen sentence against one of a good document.
CHOSEN_WEIGHT = 3.0
#: Share of labels taken to be wrong.
WRONG = 0.05
#: N-grams with a smaller log-count ratio say nothing.
LEAST_RATIO = 0.7
#: N-grams that every sentence counts as having besides its own.
SHORT = 60
#: Score from which a sentence of a document labelled good is left out of the fit.
SURELY = 3.0
#: Score (log-odds) from which a document is flagged.
FLAG_FROM = 0.5

#: Digits and signs that stand for letters inside words.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_LETTER = np.arange(128, dtype=np.uint32)
for _a, _b in STANDS_FOR.items():
    _LETTER[ord(_a)] = ord(_b)

_SPACE = np.uint32(32)
_ENDS = np.array(sorted(ord(c) for c in ".!?。！？;；:："), np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _sums(index: np.ndarray, values: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """np.bincount with weights, piece by piece: it would widen whole arrays."""
    out = np.zeros(size)
    for lo in range(0, len(index), step):
        out += np.bincount(index[lo : lo + step], values[lo : lo + step], size)
    return out


class Sentences:
    """The sentences of a batch of texts as arrays: buckets of n-grams, and the sentence each belongs to."""

    def __init__(self, texts: Sequence[str | None]):
        c = chars(texts or [""], across=True)
        texts = texts or [""]
        code, kind = c.codes, c.kinds.copy()
        owner = np.repeat(np.arange(len(texts)), np.diff(c.bounds))
        newline = (code == 10) | (code == 13)

        # Digits and signs within words that have letters.
        sign = (code == ord("@")) | (code == ord("$"))
        inner = sign.copy()
        inner[1:] &= kind[:-1] == WORD
        inner[:-1] &= kind[1:] == WORD
        wordy = (kind == WORD) | inner
        digit = (code >= 48) & (code <= 57)
        run = np.cumsum(np.diff(np.concatenate([[False], wordy]).view(np.int8)) != 0)
        letters = np.bincount(run[wordy & ~digit & ~inner], minlength=run[-1] + 1 if len(run) else 1)
        spelled = (digit | inner) & wordy & (letters[run] > 1)
        code = np.where(spelled, _LETTER[np.minimum(code, 127)], np.where(digit, np.uint32(48), code))  # other numbers are all alike
        kind[inner & spelled] = WORD

        # Letters set apart one by one.
        word = (kind == WORD) | (kind == IDEOGRAPH)
        lone = word & ~np.concatenate([[False], word[:-1]]) & ~np.concatenate([word[1:], [False]])
        apart = ~word & ~newline & np.concatenate([[False], lone[:-1]]) & np.concatenate([lone[1:], [False]])
        keep = ~apart
        code, kind, owner, newline = code[keep], kind[keep], owner[keep], newline[keep]

        # Sentences end at line ends, and at marks that no letter follows.
        word = (kind == WORD) | (kind == IDEOGRAPH)
        after = np.concatenate([word[1:] & (kind[1:] == WORD), [False]])
        end = newline | np.isin(code, _ENDS) & ~(after & (code < 128))
        end[-1:] = True
        sentence = np.concatenate([[0], np.cumsum(end)[:-1]])
        code = np.where(word, code, _SPACE)

        # Drawn-out letters, and runs of anything else.
        same = np.concatenate([[False], (code[1:] == code[:-1]) & (sentence[1:] == sentence[:-1])])
        first = np.flatnonzero(~same)
        length = np.diff(np.append(first, len(code)))
        run = np.cumsum(~same) - 1
        keep = ~same | word & (code != 48) & (length[run] < 3) if len(code) else same
        code, sentence, owner = code[keep], sentence[keep], owner[keep]

        used, sentence = np.unique(sentence, return_inverse=True)
        self.count = len(used)
        self.owner = np.zeros(self.count, np.int64)
        self.owner[sentence] = owner
        grams, whose = [], []
        h = np.zeros(len(code), np.uint64)
        wide = code.astype(np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = (h[:m] + wide[n - 1 :] + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
            if n in ORDERS:
                inside = sentence[:m] == sentence[n - 1 :]
                grams.append((h[inside] >> np.uint64(64 - 18)).astype(np.int32))
                whose.append(sentence[:m][inside].astype(np.int32))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        self.whose = np.concatenate(whose) if whose else np.zeros(0, np.int32)
        #: Hash of each sentence.
        self.key = np.zeros(self.count, np.uint64)
        np.add.at(self.key, sentence, (wide + np.uint64(7)) * _MIX * (np.arange(len(code)) - self._begin(sentence) + 1).astype(np.uint64))
        self.size = np.bincount(self.whose, minlength=self.count).astype(np.float32)

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Sentences:
        """The same, a portion at a time: what is needed on the way does not grow with the number of texts."""
        self = cls([])
        self.count, self.grams, self.whose, self.owner, self.key, self.size = 0, [], [], [], [], []
        for lo in range(0, len(texts), AT_ONCE):
            part = cls(texts[lo : lo + AT_ONCE])
            self.grams.append(part.grams)
            self.whose.append(part.whose + np.int32(self.count))
            self.owner.append(part.owner + lo)
            self.key.append(part.key)
            self.size.append(part.size)
            self.count += part.count
        for name in ("grams", "whose", "owner", "key", "size"):
            setattr(self, name, np.concatenate(getattr(self, name)))
        return self

    @staticmethod
    def _begin(sentence: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        return np.repeat(first, np.diff(np.append(first, len(sentence))))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each sentence the weights of its n-grams, over the root of their number (and SHORT, so that a few can't carry a short one)."""
        total = _sums(self.whose, weights[self.grams], self.count)
        return (total / np.sqrt(self.size + SHORT)).astype(np.float32)


class AbuseModel:
    """Weights of n-grams (log-count ratio times fitted coefficient) and an intercept."""

    def __init__(self, texts: Sequence[str], bad: Sequence[bool]):
        self.weights, self.intercept = np.zeros(BUCKETS, np.float32), -10.0
        if not any(bad) or all(bad):
            return
        s = Sentences.of(texts)
        from_bad = np.asarray(bad, bool)[s.owner]
        good = ~from_bad
        common = self._common(s.key, from_bad)
        chosen = from_bad.copy()
        score = np.zeros(s.count, np.float32)
        for r in range(ROUNDS):
            ratio = self._ratio(s, chosen, good)
            if r == 0:
                coefficient, self.intercept = np.ones(BUCKETS, np.float32), 0.0
            else:
                coefficient = self._fit(s, ratio, chosen, good)
            self.weights = (ratio * coefficient).astype(np.float32)
            score = s.sums(self.weights) + self.intercept
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, s.owner, score)
            floor = float(np.quantile(score[~from_bad], 0.998)) if r == 0 else 0.0
            # A bad document's bad sentences. A good document's sentence that scores as bad without doubt was judged wrongly.
            chosen = from_bad & (score > floor) & ~common
            good = ~from_bad & (score < (np.inf if r == 0 else SURELY))
            if not chosen.any():
                break

    @staticmethod
    def _common(keys: np.ndarray, from_bad: np.ndarray) -> np.ndarray:
        """Sentences that, word for word, are likelier harmless ones, whose documents are bad as often as any, than bad ones, whose documents are labelled good by mistake only."""
        _, which = np.unique(keys, return_inverse=True)
        bad, good = np.bincount(which, from_bad), np.bincount(which, ~from_bad)
        share = from_bad.mean()
        return (bad * np.log((1 - WRONG) / share) + good * np.log(WRONG / (1 - share)) <= 0)[which]

    @staticmethod
    def _ratio(s: Sentences, chosen: np.ndarray, good: np.ndarray) -> np.ndarray:
        p, q = (_sums(s.grams, side[s.whose].astype(np.float32), BUCKETS) for side in (chosen, good))
        # Each side is smoothed by its share of the n-grams, so that one seen on neither side says nothing.
        a, b = p.sum(), q.sum()
        ratio = np.log((p + SMOOTHING * a / (a + b)) / a) - np.log((q + SMOOTHING * b / (a + b)) / b)
        ratio[np.abs(ratio) < LEAST_RATIO] = 0
        return ratio.astype(np.float32)

    def _fit(self, s: Sentences, ratio: np.ndarray, chosen: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Logistic regression by Adam over the chosen and the good sentences."""
        used = chosen | good
        at = used[s.whose] & (ratio[s.grams] != 0)
        present = np.zeros(BUCKETS, bool)
        present[s.grams[at]] = True
        columns = np.flatnonzero(present)
        grams = (np.cumsum(present, dtype=np.int32) - 1)[s.grams[at]]
        whose = s.whose[at]
        x = (ratio[s.grams[at]] / np.sqrt(s.size + SHORT)[whose]).astype(np.float32)
        y = chosen.astype(np.float32)
        side = np.where(chosen, CHOSEN_WEIGHT, 1.0) * used / (CHOSEN_WEIGHT * chosen.sum())
        w, b = np.full(len(columns), 0.5, np.float32), -3.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, STEPS + 1):
            z = _sums(whose, x * w[grams], s.count) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * side
            gw = _sums(grams, x * g[whose].astype(np.float32), len(columns)).astype(np.float32) + PENALTY * w
            gb = g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            step = RATE / (1 + t / 20)
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
        self.intercept = float(b)
        out = np.zeros(BUCKETS, np.float32)
        out[columns] = w
        return out

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Of each text its worst sentence's score; the intercept alone for an empty or null one."""
        if not len(texts):
            return np.zeros(0)
        out = np.full(len(texts), min(self.intercept, FLAG_FROM - 1), np.float64)
        s = Sentences(texts)
        np.maximum.at(out, s.owner, s.sums(self.weights) + self.intercept)
        return out


def fit(docs: DataFrame, labels: DataFrame, size: int = FIT_DOCUMENTS) -> AbuseModel:
    """A model from at most ``size`` labelled documents of at most FIT_CHARS characters, those with the least hash of their ids.

    Repeated labels count once; a document judged both ways counts by the majority, and not at all
    on a tie; undecided labels don't count.
    """
    votes = labels.where("verdict IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates().groupBy("doc_id").agg(F.avg("verdict").alias("verdict")).where("verdict <> 0.5")
    picked = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").where(F.length("text") <= FIT_CHARS).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    return AbuseModel([r.text for r in rows], [r.verdict > 0.5 for r in rows])


def score_documents(docs: DataFrame, labels: DataFrame | None = None, model: AbuseModel | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``score`` (log-odds of the worst sentence) and ``flagged`` of every document.

    Every row of ``docs`` gives one row. Null and empty texts get a score below the threshold; texts
    of any length are scored whole. Without labels of both kinds nothing is flagged.
    """
    if model is None:
        model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = spread(docs.select("doc_id", *keep, "text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "text")
    names = [c for c in wanted.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score = np.concatenate([np.zeros(0), *(m.scores(x.to_pylist()) for x in portions(b.column("text"), 512))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score), pa.array(score > FLAG_FROM)], names=[*names, "score", "flagged"])

    return wanted.mapInArrow(run, f"{schema}, score double, flagged boolean")


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``source``, ``n_docs``, ``n_flagged`` and ``rate`` (to six places); documents without a source make one of their own."""
    scored = score_documents(docs, labels, keep=["source"])
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("flagged").cast("bigint")).alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"))
