"""Language identification by interpolated Kneser-Ney character models.

One model per language over lower-cased letters (all else is a space). Each order's n-grams lie in one sorted array of 64-bit
hashes for all languages, with a row of log probabilities, one for each language, in which the languages that lack the n-gram
already hold their backed-off value; contexts have an array of their own with the backoff weights. A text goes to the
language with the lowest cross-entropy per character. The score is calibrated on documents left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
UNDETERMINED = "und"
_FOLD: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Code points, letters in lower case, each run of anything else one space; starts with a full context of spaces."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
                table[c] = ord(ch.lower()[0])
        _FOLD.append(table)
    x = _FOLD[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    space = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return np.concatenate([np.full(ORDER - 1, 32, np.uint32), x[keep]])


def hashes(x: np.ndarray) -> list[np.ndarray]:
    """hashes(x)[k][i]: of the k characters that end at i; k from 0."""
    with np.errstate(over="ignore"):
        one = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        one ^= one >> np.uint64(29)
        out = [np.zeros(len(x), np.uint64)]
        for k in range(1, ORDER + 1):
            before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
            h = before * np.uint64(0xBF58476D1CE4E5B9) + one + np.uint64(k)
            out.append(h ^ (h >> np.uint64(31)))
    return out


class Sorted:
    """A sorted array of hashes with rows of values, entered through an index of the leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        lead = (keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange(1 << bits)).astype(np.int32)
        self.deepest = int(np.bincount(lead, minlength=1).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        at = self.start[(h >> self.shift).astype(np.int64)]
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        for _ in range(self.deepest):
            ok = at < len(self.keys)
            left, at = left[ok], at[ok]
            k, q = self.keys[at], h[left]
            out[left[k == q]] = at[k == q]
            go = k < q
            left, at = left[go], at[go] + 1
            if not len(left):
                break
        return out


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        fitted, held = {}, []
        for n, lang in enumerate(self.langs):
            docs = samples[lang]
            some = docs[::5] if len(docs) >= 10 else []
            held += [(n, t) for t in some]
            fitted[lang] = [t for k, t in enumerate(docs) if k % 5 or not some]
        self._count([fitted[x] for x in self.langs])
        self._calibrate(held)

    def _count(self, samples: list[list[str]]) -> None:
        size = len(samples)
        grams: list[list[tuple]] = []
        for docs in samples:
            x = np.concatenate([folded(t) for t in docs])
            h = hashes(x)
            inside = np.concatenate([np.arange(k := len(folded(t))) >= ORDER - 1 for t in docs])
            per, cont = [None] * (ORDER + 1), None
            for k in range(ORDER, 0, -1):
                u, first, raw = np.unique(h[k][inside], return_index=True, return_counts=True)
                first = np.flatnonzero(inside)[first]
                if cont is not None:  # distinct left neighbours
                    raw = np.maximum(1, cont[np.minimum(np.searchsorted(cont_keys, u), len(cont_keys) - 1)])
                ctx = h[k - 1][first - 1] if k > 1 else np.zeros(len(u), np.uint64)
                low = h[k - 1][first]
                cont_keys, cont = np.unique(low, return_counts=True)
                per[k] = (u, raw.astype(np.float64), ctx, low)
            grams.append(per)
        self.alphabet = len(np.unique(np.concatenate([p[1][0] for p in grams]))) + 1
        below = [(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(size)]
        unseen = np.full(size, -np.log(self.alphabet))
        self.probs: list[Sorted | None] = [None] * (ORDER + 1)
        self.weights: list[Sorted | None] = [None] * (ORDER + 1)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([p[k][0] for p in grams]))
            ctxs = np.unique(np.concatenate([p[k][2] for p in grams]))
            logp, lam = np.zeros((len(keys), size)), np.zeros((len(ctxs), size))
            of_ctx, of_low = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint64)
            for u, _, ctx, low in (p[k] for p in grams):
                at = np.searchsorted(keys, u)
                of_ctx[at], of_low[at] = np.searchsorted(ctxs, ctx), low
            if k == 1:
                lower = np.tile(unseen, (len(keys), 1))
            else:
                lower = self.probs[k - 1].rows[np.searchsorted(self.probs[k - 1].keys, of_low)].astype(np.float64)
            for n, p in enumerate(grams):
                u, c, ctx, _ = p[k]
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                j = np.searchsorted(ctxs, ctx)
                total = np.bincount(j, c, len(ctxs))
                kinds = np.bincount(j, minlength=len(ctxs))
                seen = total > 0
                lam[seen, n] = np.log(np.minimum(1.0, d * kinds[seen] / total[seen]))
                logp[:, n] = lower[:, n] + lam[of_ctx, n]
                at = np.searchsorted(keys, u)
                logp[at, n] = np.log(np.maximum(c - d, 0) / total[j] + np.exp(lam[j, n] + lower[at, n]))
            self.probs[k] = Sorted(keys, logp.astype(np.float32))
            self.weights[k] = Sorted(ctxs, lam.astype(np.float32))
        self.unseen = unseen.astype(np.float32)

    def entropies(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability of each folded text under each language, and the characters that it is taken over."""
        h = hashes(np.concatenate(parts))
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        inside = np.ones(ends[-1], bool)
        for k in range(ORDER - 1):
            inside[(ends - sizes) + k] = False
        at = np.flatnonzero(inside)
        out = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            found = self.probs[k].find(h[k][at[left]])
            hit = found >= 0
            out[left[hit]] += self.probs[k].rows[found[hit]]
            left = left[~hit]
            if not len(left):
                break
            w = self.weights[k].find(h[k - 1][at[left] - 1]) if k > 1 else np.zeros(len(left), np.int32)
            ok = w >= 0
            out[left[ok]] += self.weights[k].rows[w[ok]]
        out[left] += self.unseen
        n = sizes - (ORDER - 1)
        starts = np.cumsum(n) - n
        sums = np.zeros((len(parts), len(self.langs)))
        if len(out):
            full = n > 0
            sums[full] = np.add.reduceat(out, starts[full], axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], n

    def _calibrate(self, held: list[tuple[int, str]]) -> None:
        """The temperature with the best likelihood over held-out documents and short cuts of them; each language's usual entropy."""
        self.heat, self.usual = 1.0, np.full((len(self.langs), 2), (99.0, 1.0))[: len(self.langs)].reshape(-1, 2)
        cuts = [(n, folded(t[a : a + size])) for n, t in held for size in (20, 60, 200) for a in (0, len(t) // 2)] + [(n, folded(t)) for n, t in held]
        cuts = [(n, x) for n, x in cuts if (x != 32).any()]
        if not cuts:
            return
        xe, size = self.entropies([x for _, x in cuts])
        who = np.array([n for n, _ in cuts])
        best = (np.inf, 1.0)
        for heat in 2.0 ** np.arange(-3, 5, 0.5):
            z = -heat * xe * np.sqrt(size)[:, None]
            z -= z.max(1, keepdims=True)
            nll = -(z[np.arange(len(who)), who] - np.log(np.exp(z).sum(1))).mean()
            best = min(best, (nll, heat))
        self.heat = best[1]
        for n in range(len(self.langs)):
            own = xe[who == n, n]
            if len(own):
                self.usual[n] = own.mean(), max(own.std(), 0.05)

    def predict(self, parts: list[np.ndarray]) -> tuple[list[str], list[float], np.ndarray]:
        xe, size = self.entropies(parts)
        z = -self.heat * xe * np.sqrt(np.maximum(size, 1))[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        pick = xe.argmin(1)
        own = xe[np.arange(len(pick)), pick]
        far = np.maximum(0, (own - self.usual[pick, 0]) / self.usual[pick, 1] - 3)
        score = z[np.arange(len(pick)), pick] / z.sum(1) * np.exp(-far)
        letters = [bool((p != 32).any()) for p in parts]
        langs = [self.langs[k] if ok else UNDETERMINED for k, ok in zip(pick, letters)]
        return langs, [float(s) if ok else 0.0 for s, ok in zip(score, letters)], own


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, longest: int = 100_000) -> Model | None:
    """From a bounded sample: at most per_language documents of each language, those with the smallest hash of their id among
    those of at most `longest` code points. None if no row has both a text with a letter and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.char_length(text_col) <= longest))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    ids = common.bounded_ids(rows.select("_id", "_lang"), "_id", ["_lang"], per_language).select("_id").distinct()
    picked = rows.join(F.broadcast(ids), "_id").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["_lang"], r["_id"], r["_text"])):
        if any(map(str.isalpha, r["_text"])):
            samples.setdefault(r["_lang"], []).append(r["_text"])
    return Model(samples) if samples else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.0) -> DataFrame:
    """One row per input row: id_col, lang_pred, score, cross_entropy (nats per character).

    lang_pred is `und`, with score 0, if the text is null or has no letter, if the score is under reject_below, or without a
    model. Null and repeated ids pass through; ties go to the language that sorts first. Only text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in common.rows_of(batches, "id", "text"):
            langs, scores, xe = [], [], []
            group, held = [], 0
            for k, t in enumerate(texts):
                group.append(folded(t))
                held += len(t)
                if held > 1 << 19 or k == len(texts) - 1:
                    a, b, c = m.predict(group) if m else ([UNDETERMINED] * len(group), [0.0] * len(group), np.zeros(len(group)))
                    langs += [x if s >= reject_below else UNDETERMINED for x, s in zip(a, b)]
                    scores += b
                    xe += c.tolist()
                    group, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(xe, pa.float64())], names=["id", "lang_pred", "score", "cross_entropy"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double, cross_entropy double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs.where(common.crc_mod("doc_id", 5) != 0))
    out = identify(docs, model)
    return out.select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy")


SQL = None
