"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece the table holds the one token that can end its encoding. A prefix that ends in token t is valid
when t stands alone, or when the table's token for what comes before t, followed by t, is a pair that BPE leaves apart.
Exactly one token meets this for each prefix, so an append only fills in the new entries, and an edit keeps the entries
before it. Reading the table backwards from the end gives the encoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


#: Patterns whose matches may be cut before a single space: a fixed value, the published pattern of the vocabulary's family.
CUTS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


class PrefixBPE:
    """Encoder and decoder over ranks (bytes -> id); all 256 single bytes must be among them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 300_000):
        self.ranks, self.token = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.find = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ending = ahocorasick.Automaton()  # finds all tokens that end at a place
        for b, i in ranks.items():
            self.ending.add_word(b.decode("latin-1"), (i, len(b)))
        self.ending.make_automaton()
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.cuts, self.inside = pattern in CUTS, regex.compile(r" (?<=\s )(?=\s|\Z)").search
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache = cache

    def merged(self, data: bytes) -> list[int]:
        """Plain rank-order merging, for short inputs: the definition that the table must agree with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, t: int) -> tuple[list, list] | None:
        """The tokens that stand at t's right end, and at its left end, while t is merged: (bytes, rank) from a single byte up
        to t. None if plain merging of t's bytes doesn't give t."""
        if t not in self.spines:
            data = self.token[t]
            right, left = [(data[-1:], -1)], [(data[:1], -1)]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                best, at = min([(self.ranks.get(x + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))])
                if best == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == len(parts) - 1:
                    right.append((parts[at], best))
                if at == 0:
                    left.append((parts[0], best))
            self.spines[t] = (right, left) if len(parts) == 1 else None
        return self.spines[t]

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE of token a's bytes followed by token b's leaves the border between them: while both sides grow in rank
        order, no pair of tokens that meet at the border may merge before one of them is taken inwards."""
        right, left = self.spine(a)[0], self.spine(b)[1]
        ranks, i, j = self.ranks, 0, 0
        while True:
            across = ranks.get(right[i][0] + left[j][0], 1 << 40)
            inner = right[i + 1][1] if i + 1 < len(right) else 1 << 40
            outer = left[j + 1][1] if j + 1 < len(left) else 1 << 40
            if across < inner and across <= outer and across < 1 << 40:
                return False  # of equal ranks the leftmost merges first
            if inner == outer == 1 << 40:
                return True
            if inner <= outer:
                i += 1
            else:
                j += 1

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """last[i]: the token that ends data[:i]; entries for the rest of data are appended."""
        pairs, done, base = self.pairs, len(last), max(0, len(last) - self.longest)
        last += [-2] * (len(data) + 1 - done)
        for end, (t, size) in self.ending.iter(data[base:].decode("latin-1")):
            end += base + 1
            if last[end] != -2:
                continue
            key = (last[end - size], t)
            ok = pairs.get(key)
            if ok is None:
                if len(pairs) > 400_000:
                    pairs.clear()
                ok = pairs[key] = self.spine(t) is not None and (end == size or self.apart(*key))
            if ok:
                last[end] = t
        return last

    def backwards(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at > 0:
            ids.append(last[at])
            at -= len(self.token[last[at]])
        return ids[::-1]

    def piece(self, data: bytes) -> list[int]:
        t = self.ranks.get(data)
        return [t] if t is not None else self.backwards(self.extend([-1], data))

    def packed(self, chunk: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for p in self.find(chunk) for i in self.piece(p.encode())])

    def missed(self, word: str) -> bytes:
        """The packed ids of a space and a word, from a cache of two generations of bounded size."""
        out = self.young.get(word) or self.old.get(word)
        if out is None:
            out = self.packed(" " + word)
        if len(word) <= 64:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[word] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        """All ids as little-endian 32-bit integers. Every match of the pattern that holds a space begins with it, unless the
        space lies inside a longer run of white space; so the text is cut before single spaces, and cut words are cached."""
        if not self.cuts or self.inside(text):
            return self.packed(text)
        first, *words = text.split(" ")
        out = list(map(self.young.get, words))
        if None in out:
            missed = self.missed
            out = [missed(w) if x is None else x for w, x in zip(words, out)]
        return self.packed(first) + b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_packed(text)).cast("I"))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Tokenised:
    """A text with its tables, which can be appended to and edited; ids() always equals a fresh encoding."""

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text, self.parts = bpe, "", []
        self.append(text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]. Pieces well before the edit keep their tables; a piece with the same beginning keeps
        the entries of that beginning; after the edit, pieces are taken over from where the old borders come back."""
        old, text = self.parts, self.text[:start] + new + self.text[end:]
        kept = [p for p in old if p[1] < start]
        kept = kept[:-2]  # a match can depend on what follows it
        at, parts = kept[-1][1] if kept else 0, list(kept)
        shift = len(text) - len(self.text)
        later = {p[0] + shift: k for k, p in enumerate(old) if p[0] >= end}
        near = {p[0]: p for p in old[len(kept) :] if p[0] <= start}
        for m in self.bpe.spans(text, at):
            a, b = m.span()
            if a in later and a >= start + len(new):
                parts += [(p[0] + shift, p[1] + shift, p[2], p[3]) for p in old[later[a] :]]
                break
            data = m.group().encode()
            last = [-1]
            if a in near:
                was = near[a][2]
                same = next((i for i, (x, y) in enumerate(zip(was, data)) if x != y), min(len(was), len(data)))
                last = near[a][3][: same + 1]
            parts.append((a, b, data, self.bpe.extend(last, data)))
        self.text, self.parts = text, parts

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        out = []
        for _, _, data, last in self.parts:
            t = self.bpe.ranks.get(data)
            out += [t] if t is not None else self.bpe.backwards(last)
        return out


def load(vocabulary: bytes, pattern: str) -> PrefixBPE:
    """From the bytes of a .tiktoken file; kept per process until another operator runs in it."""
    made = lambda: PrefixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}, pattern)
    return common.held("bpe", (hashlib.md5(vocabulary).digest(), pattern), made)


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256, decoded_sha256, and ids (little-endian 32-bit integers,
    binary) if with_ids.

    vocabulary: path of a .tiktoken file, read by the driver alone and broadcast (its size is that of the file). A null text
    counts as empty: no ids and the digest of no bytes. Null and repeated ids pass through. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    types = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(raw.value, pattern)
        for ids, texts in common.rows_of(batches, "id", "text", owner="bpe"):
            rows = []
            for i, text in zip(ids, texts):
                packed = bpe.encode_packed(text)
                tokens = memoryview(packed).cast("I")
                rows.append((i, len(tokens), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(tokens)).hexdigest(), packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return common.texts(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(common.read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


SQL = None
