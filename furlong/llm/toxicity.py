"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on sentences.

Two words, with marks at their ends, are compared by the subsequences of three characters that they share; a subsequence may
skip up to two characters, each at a factor of DECAY, so an insult with gaps or inserted characters stays close to itself. Two
sentences are compared by the sum of this over the pairs of their distinct words, a convolution kernel; sentences of more than
WINDOW words count as several. Seen through the landmarks, a sentence is the sum of its words' kernels with them, and the
machine is a linear one on these sums.

Labels are for texts: all sentences of clean texts are clean, and each toxic text has at least one toxic sentence. The machine
learns which: it starts from the sentence with the word that most tells toxic from clean texts, and alternates between fitting
and choosing the worst sentence of each toxic text and the clean sentences that are hardest. A text is as toxic as its worst
sentence. Probabilities are fitted to texts that were held back. Scoring sums the values of a sentence's words, which are
computed once for each distinct word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality

DECAY = 0.5
STEPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
OTHER = re.compile(r"[\W\d_]+")
ENDS = re.compile(r"^[\W_]+|[\W_]+$")
LONGEST = 24
WINDOW = 32
ROUNDS = 3
SHARP = 6.0
EMPTY = -9.0
MARGIN = 1.5


def pieces(word: str) -> list[str]:
    """A word between marks; one that is longer than LONGEST in overlapping windows, so that none of it is left out."""
    word = ENDS.sub("", word)
    if len(word) <= LONGEST:
        return [f"^{word}$"] if word else []
    whole = f"^{word}$"
    return [whole[k : k + LONGEST] for k in range(0, len(whole) - LONGEST // 2, LONGEST // 2)]


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as lists of lower-case words without signs at their ends; of more than WINDOW words, several.

    Words with signs inside also count without them, and three or more short words in a row, whatever the blanks and signs
    between them, as the word that they spell; these stand in sentences of their own.
    """
    out, now, more, ones, twos = [], [], [], [], []
    for w in text.lower().split():
        if w.isalpha():
            bare, last = w, False
            now.append(w)
        else:
            plain, bare, last = ENDS.sub("", w), OTHER.sub("", w), w[-1] in ".!?"
            if plain:
                now.append(plain)
            if len(bare) > 1 and bare != plain:
                more.append(bare)
        # runs of single letters, and of words of at most two
        if len(bare) <= 2:
            twos.append(bare)
        elif twos:
            if len(twos) > 2:
                more.append("".join(twos))
            twos = []
        if len(bare) <= 1:
            ones.append(bare)
        elif ones:
            if len(ones) > 2:
                more.append("".join(ones))
            ones = []
        if last or len(now) >= WINDOW:
            out.append(now)
            now = []
    more += ["".join(run) for run in (ones, twos) if len(run) > 2]
    out.append(now)
    out += [more[k : k + WINDOW] for k in range(0, len(more), WINDOW)]
    return [x for x in out if x]


def occurrences(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each string, a row of subsequence keys (0: none) and a row of their weights."""
    size = max(map(len, strings))
    x = np.zeros((len(strings), size), np.uint64)
    for k, s in enumerate(strings):
        x[k, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.uint32) & 0xFFFFF
    keys, weights = [], []
    for a, b in STEPS:
        if b < size:
            one, two, three = x[:, : size - b], x[:, a : size - b + a], x[:, b:]
            keys.append(np.where(three > 0, one | (two << np.uint64(20)) | (three << np.uint64(40)), 0))
            weights.append(np.full(keys[-1].shape[1], DECAY ** (b - 2)))
    if not keys:
        return np.zeros((len(strings), 1), np.uint64), np.zeros(1)
    return np.concatenate(keys, 1), np.concatenate(weights)


def summed(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each string in order, with each key's whole weight at its last place (else 0), scaled to norm 1."""
    keys, weights = occurrences(strings)
    order = np.argsort(keys, 1)
    keys = np.take_along_axis(keys, order, 1)
    w = np.where(keys > 0, weights[order], 0)
    total = np.cumsum(w, 1)
    last = np.ones(keys.shape, bool)
    last[:, :-1] = keys[:, 1:] != keys[:, :-1]
    ends = np.where(last, total, 0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(keys), 1)), ends[:, :-1]], 1), 1)
    value = np.where(last & (keys > 0), total - before, 0)
    return keys, value / np.maximum(np.sqrt((value**2).sum(1, keepdims=True)), 1e-12)


class Kernel:
    """Kernels of strings with the landmarks: exp(SHARP (k - 1)) of the normalised subsequence kernel k, itself a kernel."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        keys, value = summed(landmarks)
        self.table = np.unique(keys[value > 0])
        self.dense = np.zeros((len(self.table) + 1, len(landmarks)), np.float32)
        for k in range(len(landmarks)):
            ok = value[k] > 0
            self.dense[np.searchsorted(self.table, keys[k][ok]), k] = value[k][ok]

    def places(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.table, keys), len(self.table) - 1)
        return np.where(self.table[at] == keys, at, len(self.table))

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), self.dense.shape[1]), np.float32)
        for k in range(0, len(strings), 250):  # so that what is gathered stays in the processor's cache
            keys, value = summed(strings[k : k + 250])
            at = self.places(keys)
            rows, cols = np.nonzero((value > 0) & (at < len(self.table)))
            if len(rows):
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                found = self.dense[at[rows, cols]]
                found *= value[rows, cols].astype(np.float32)[:, None]
                out[k + rows[first]] = np.add.reduceat(found, first, axis=0)
        out -= 1
        out *= SHARP
        return np.exp(out, out=out)

    def each(self, strings: list[str], f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """f of the strings' rows of kernels, of which no more than a few thousand are held."""
        return np.concatenate([f(self(strings[k : k + 4000])) for k in range(0, len(strings), 4000)]) if strings else np.zeros(0)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0) -> np.ndarray:
    """Newton steps on the primal; the last column of x is the constant and is hardly penalised."""
    pen = np.r_[np.ones(x.shape[1] - 1), 1e-3]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * weight[on][:, None]
        new = np.linalg.solve(np.diag(pen) + 2 * c * a.T @ x[on], 2 * c * a.T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


class Bags:
    """Sentences of texts as pairs of sentence and word numbers."""

    def __init__(self, texts: list[str]):
        names: dict[str, int] = {}
        text_of, sent, word = array("i"), array("i"), array("i")
        for k, t in enumerate(texts):
            for s in sentences(t):
                own = {names.setdefault(p, len(names)) for w in s for p in pieces(w)}
                sent.extend([len(text_of)] * len(own))
                word.extend(own)
                text_of.append(k)
        self.words, self.texts = list(names), len(texts)
        self.sent, self.word, self.text_of = (np.array(x, np.int32) for x in (sent, word, text_of))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each sentence, the sum of its words' values."""
        return np.bincount(self.sent, values[self.word], len(self.text_of))

    def worst(self, values: np.ndarray) -> np.ndarray:
        """Of each text, the place of the sentence with the highest value; -1 without one."""
        out = np.full(self.texts, -1)
        order = np.argsort(values, kind="stable")
        out[self.text_of[order]] = order
        return out

    def seen(self, kernel: Kernel, some: np.ndarray) -> np.ndarray:
        """Some sentences through the landmarks, a thousand at a time."""
        first = np.searchsorted(self.sent, np.arange(len(self.text_of) + 1))
        out = np.zeros((len(some), len(kernel.landmarks)))
        for lo in range(0, len(some), 1000):
            part = [self.word[first[k] : first[k + 1]] for k in some[lo : lo + 1000]]
            used, at = np.unique(np.concatenate(part), return_inverse=True)
            k = kernel([self.words[w] for w in used])
            size = np.array([len(x) for x in part])
            starts = np.cumsum(size) - size
            full = size > 0
            out[lo : lo + len(part)][full] = np.add.reduceat(k[at], starts[full], axis=0)
        return out


class Machine:
    def __init__(self, rows: list[tuple[str, int]], landmarks: int = 128, counts: dict[int, int] | None = None, active: int = 6000):
        """rows: (text, label). Without rows of both labels every score is that of the one label, or 0 without any.

        counts: how many texts of each label those of rows stand for (if not given, themselves); the probabilities follow them.
        active: how many clean sentences take part in a fit: half of them drawn, half those that scored highest in the fit before,
        of all that there are.
        """
        self.cache: dict[str, float] = {}
        self.only = None if {y for _, y in rows} == {0, 1} else float(rows[0][1]) if rows else 0.0
        if self.only is not None:
            return
        y = np.array([y for _, y in rows])
        nth = np.array([(y[:k] == v).sum() for k, v in enumerate(y)])
        held = (nth % 5 == 4) if min((y == 0).sum(), (y == 1).sum()) >= 20 else np.zeros(len(y), bool)
        bags = Bags([t for (t, _), h in zip(rows, held) if not h])
        label = y[~held]
        if not (label[bags.text_of] == 1).any():
            self.only = 0.0
            return
        in_text = np.unique(bags.text_of[bags.sent].astype(np.int64) * len(bags.words) + bags.word)
        of, word = np.divmod(in_text, len(bags.words))
        bad, good = (np.bincount(word[label[of] == v], minlength=len(bags.words)) for v in (1, 0))
        n = [max(1, int((label == v).sum())) for v in (0, 1)]
        odds = np.log((bad + 0.1) / n[1]) - np.log((good + 0.1) / n[0])
        rank = np.where(bad > 0, odds * np.sqrt(bad), -99.0)
        named = lambda at: [bags.words[k] for k in at]
        by = lambda x, on: [k for k in np.lexsort((np.array(bags.words), -x)) if on[k]]
        best = named(by(rank, bad > 0)[: landmarks * 3])
        often = named(by(good.astype(float), good > 0))
        marks = self._spread(best, landmarks // 2)
        usual = often[: landmarks // 4]
        like = Kernel(marks).each(often, lambda k: k.max(1))
        # clean words close to the worst ones, so that the border between them can be drawn
        usual += self._spread([often[k] for k in np.argsort(-like, kind="stable")[:200]], landmarks // 4)
        marks += [w for w in usual if w not in marks]
        kernel = Kernel(marks)
        value, vector = np.linalg.eigh(kernel(marks).astype(np.float64))
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T  # K^(-1/2)
        clean = np.flatnonzero(label[bags.text_of] == 0)
        drawn = np.random.default_rng(7).permutation(clean)[: active // 2]
        strong = (bad >= max(3.0, 0.015 * n[1])) & (odds > 2.5)
        marked = np.zeros(len(bags.text_of), bool)
        marked[bags.sent[strong[bags.word]]] = True
        seeds = np.flatnonzero(marked & (label[bags.text_of] == 1))
        seeded = np.bincount(bags.text_of[seeds], minlength=bags.texts)
        score = np.full(len(bags.text_of), -99.0)
        np.maximum.at(score, bags.sent, rank[bags.word])
        hard = drawn[:0]
        for _ in range(ROUNDS):
            # toxic texts without a telling word take part with their worst sentence, and count little until it scores as toxic
            others = bags.worst(score)[(label == 1) & (seeded == 0)]
            others = others[others >= 0]
            some = np.r_[seeds, others, np.union1d(drawn, hard)]
            sign = np.r_[np.ones(len(seeds) + len(others)), -np.ones(len(some) - len(seeds) - len(others))]
            weight = np.r_[1.0 / seeded[bags.text_of[seeds]], np.where(score[others] > 0, 0.5, 0.05), np.ones(len(some) - len(seeds) - len(others))]
            for c, total in ((1, 1000), (-1, 6000)):
                weight[sign == c] *= total / max(weight[sign == c].sum(), 1e-9)
            x = np.c_[bags.seen(kernel, some) @ root, np.ones(len(some))]
            w = squared_hinge(x, sign, weight)
            self._linear(kernel, root @ w[:-1], w[-1])
            score = bags.sums(self.values(bags.words)) + self.bias
            hard = clean[np.argsort(-score[clean], kind="stable")[: active // 2]]
        if held.any():
            tops, label = np.array(self.tops([t for (t, _), h in zip(rows, held) if h])), y[held]
        else:
            at = bags.worst(score)
            tops = np.where(at >= 0, score[at], EMPTY)
        self._platt(np.clip(tops, -MARGIN, MARGIN), label.astype(float), quality.weights(label, counts))
        self.cache.clear()

    @staticmethod
    def _spread(best: list[str], most: int) -> list[str]:
        """The best words, without those that are nearly the same as one before."""
        if not best:
            return []
        same = Kernel(best)(best)
        kept: list[int] = []
        for k in range(len(best)):
            if len(kept) < most and all(same[k, j] < 0.8 for j in kept):
                kept.append(k)
        return [best[k] for k in kept]

    def _linear(self, kernel: Kernel, beta: np.ndarray, bias: float) -> None:
        self.kernel, self.beta, self.bias = kernel, beta, float(bias)
        self.cache.clear()

    def _platt(self, f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        a, b = 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
            v = weight * np.maximum(p * (1 - p), 1e-6)
            e = weight * (p - t)
            g = np.array([(e * f).sum() + 1e-3 * a, e.sum()])
            h = np.array([[(v * f * f).sum() + 1e-3, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.slope, self.shift = float(a), float(b)

    def value(self, piece: str) -> float:
        if piece not in self.cache:
            self.cache[piece] = float(self.values([piece])[0])
        return self.cache[piece]

    def values(self, strings: list[str]) -> np.ndarray:
        """What each word adds to its sentence's score."""
        return self.kernel.each(strings, lambda k: k @ self.beta.astype(np.float32)).astype(np.float64)

    def learn(self, unknown: list[str]) -> None:
        """Puts words in the cache; a word in several pieces has the value of its worst one."""
        cut = [pieces(w) for w in unknown]
        flat = sorted({p for c in cut for p in c}, key=len)
        known = dict(zip(flat, self.values(flat).tolist())) if flat else {}
        for w, c in zip(unknown, cut):
            self.cache[w] = max((known[p] for p in c), default=0.0)

    def tops(self, texts: list[str]) -> list[float]:
        """The score of each text's worst sentence."""
        out: list[float] = []
        for at in range(0, len(texts), 64):
            if len(self.cache) > 300_000:  # bounds the cache; what goes is computed again
                self.cache.clear()
            some = [list(map(set, sentences(t))) for t in texts[at : at + 64]]
            unknown = {w for t in some for s in t for w in s}.difference(self.cache)
            if unknown:
                self.learn(list(unknown))
            of = self.cache.__getitem__
            out += [max((sum(map(of, s)) for s in t), default=EMPTY - self.bias) + self.bias for t in some]
        return out

    def scores(self, texts: list[str]) -> list[float]:
        if self.only is not None:
            return [self.only] * len(texts)
        return (1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.tops(texts), -MARGIN, MARGIN) + self.shift, -30, 30)))).tolist()


def train(docs: DataFrame, labels: DataFrame, allowed, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fitted on a bounded sample of labelled rows, at most per_class of each label, with the probabilities of all of them."""
    rows, counts = quality.sample(docs, labels, "toxic", allowed, per_class, id_col, text_col)
    return Machine(rows, counts=counts)


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id_col, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    A null text counts as empty; a text without a word has the lowest score. Null and repeated ids pass through. Only text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.rows_of(batches, "id", "text"):
            s = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["id", "score", "predicted"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"), common.crc_mod("_id", 4) != 2)
    return score(docs, model).select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


SQL = None
