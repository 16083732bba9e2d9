"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. All sets are sorted alike: shingles that no task saw
twice come first, the frequent ones last, the most frequent at the very end. Two similar sets share many of their first
shingles, so only a prefix of each goes into the index. A prefix is as long as the threshold asks for, and longer where the
estimated cost of candidates says so: with l - 1 more shingles, a candidate must share l. The number that a pair must share
follows from both sizes and prefix lengths and never drops a pair over the threshold.

Copies inside a task join their first copy at once. Posting lists of up to SHORT members give all their pairs. A longer list
only ties each member to one hub, the member of least hashed id, so a group of n copies costs n pairs. Lists that are known to
be very long are never gathered: their hub is an aggregate, and their postings stay rows. What these pairs verify is united
into components.

Lists that still span several components are gone through again, hub by hub: the documents below one hub are dealt into
blocks of about BLOCK by hashed id, and two blocks meet in a tile, in which all pairs of different components are counted by a
product of small matrices. So memory follows BLOCK and never the size of a group, and a large group is spread over many tasks.
Two rounds take only the blocks with themselves, dealt differently each time, at a cost linear in the group; they unite most of
a large group of near copies. The last round takes all tiles that still span components, so that no link between components is
lost, whatever the counts of frequent shingles said. A document leaves its tile, once, if with some other it can still reach its
count, by what both sets have in the lists of other hubs and by the most that either shares with any one set in short lists.
Those that do meet in the tile a second time with their whole sets, and of the links found there a spanning forest goes on. So
no step has a row for each pair of a group.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
SHORT = 24
LONGEST_EXTRA = 8
VERIFY_COST = 20.0
LONG_WORD = 256
BLOCK = 1024
HOT = 100_000
_K = np.uint64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
    codes[65:91] = codes[97:123]
    word = np.ones(256, bool)
    word[[9, 10, 11, 12, 13, 32]] = False
    codes[~word] = 0
    return codes, word


_CODES, _WORD = _tables()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; all bytes of all texts go through the same few array operations."""
    data = np.frombuffer(b"\n".join([t.encode() for t in texts]) + b"\n", np.uint8)
    with np.errstate(over="ignore"):
        power = np.full(len(data), _R, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        inverse = np.full(len(data), pow(_R, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * power)])
        edge = np.diff(np.concatenate([[False], _WORD[data], [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        for k in np.flatnonzero(end - start > LONG_WORD):  # long words could be made to collide in a polynomial
            words[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes().lower(), digest_size=8).digest(), "little")
        sizes = np.cumsum([len(t.encode()) + 1 for t in texts])
        upto = np.searchsorted(start, sizes)
        runs = words.copy()
        for k in range(1, WORDS):
            runs = _mix(runs[:-1] * np.uint64(0xBF58476D1CE4E5B9) + words[k:]) if len(runs) > 1 else runs[:0]
        out, a = [], 0
        for b in upto:
            n = b - a
            if n >= WORDS:
                x = np.sort(runs[a : b - WORDS + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif n:
                h = np.array([n], np.uint64)
                for w in words[a:b]:
                    h = _mix(h * np.uint64(0x94D049BB133111EB) + w)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            a = b
    return out


def _in_pieces(ids: list, texts: list[str], most: int = 1 << 18) -> Iterator[tuple[list, list[np.ndarray]]]:
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most or k == len(texts) - 1:
            yield ids[at : k + 1], shingle_sets(texts[at : k + 1])
            at, held = k + 1, 0


def least_shared(n_a: np.ndarray, n_b: np.ndarray, p_a: np.ndarray, p_b: np.ndarray) -> np.ndarray:
    """How many shingles of their prefixes two sets over the threshold share at least: 100 i >= 75 u asks for i >= 3 (a + b) / 7,
    and no more than the larger of the two rests lies outside the shorter prefix."""
    return np.maximum(1, (3 * (n_a + n_b) + 6) // 7 - np.maximum(n_a - p_a, n_b - p_b))


class Frequent:
    """Shingles that tasks saw more than once, with their document counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.float64)

    def arranged(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x in the common order, and each shingle's estimated document count (1 if not frequent)."""
        if not len(self.keys):
            return x, np.ones(len(x))
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        count = np.where(self.keys[at] == x, self.counts[at], 1.0)
        order = np.argsort(count, kind="stable")  # x is sorted by hash already
        return x[order], count[order]

    def prefix(self, x: np.ndarray) -> np.ndarray:
        x, count = self.arranged(x)
        n = len(x)
        least = n - (3 * n + 3) // 4 + 1
        most = min(n, least + LONGEST_EXTRA - 1)
        cost = np.cumsum(count)[least - 1 : most]
        others = cost - np.arange(least, most + 1)
        extra = np.arange(1, most - least + 2)
        return x[: least + int(np.argmin(cost + VERIFY_COST * others / extra))]


def _tally(known: tuple[np.ndarray, np.ndarray], more: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """known (sorted keys, counts) with more keys counted in; over `most` keys, the least frequent ones go."""
    keys, count = np.unique(np.concatenate(more), return_counts=True)
    both = np.concatenate([known[0], keys])
    order = np.argsort(both, kind="stable")
    both, count = both[order], np.concatenate([known[1], count])[order]
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    keys, count = both[at], np.add.reduceat(count, at) if len(at) else count
    least = 1
    while len(keys) > most:
        least += 1
        keys, count = keys[count >= least], count[count >= least]
    return keys, count


def frequent(docs: DataFrame, per_task: int = 200_000, most: int = 500_000) -> Frequent:
    """Document counts over all documents: each task counts its shingles, and of those that it saw at least twice the most
    frequent per_task go on to be summed; the `most` most frequent are kept, which bounds what is broadcast. It steers costs
    only; results do not depend on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, more, held = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for ids, texts in common.rows_of(batches, "id", "text"):
            for _, sets in _in_pieces(ids, texts):
                more += sets
                held += sum(map(len, sets))
                if held > 1 << 19:
                    known, more, held = _tally(known, more, 1 << 19), [], 0
        if more:
            known = _tally(known, more, 1 << 19)
        keys, count = known[0][known[1] > 1], known[1][known[1] > 1]
        if len(keys) > per_task:
            at = np.argsort(-count, kind="stable")[:per_task]
            keys, count = keys[at], count[at]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(count, pa.int64())], names=["s", "c"])

    top = docs.mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(most).toArrow()
    return Frequent(top["s"].to_numpy().view(np.uint64).copy(), top["c"].to_numpy())


_PARTS = "kind string, id long, n int, first long, bucket int, blob binary, p int, token long"


def _index(docs: DataFrame, freq: Frequent, buckets: int, hot: int, flush: int = 300_000) -> DataFrame:
    """kind d: (id, n, first: the copy in the same task that stands for it, or null); kind p: packed postings of a bucket; kind
    h: (token, id, n, p), a posting of a shingle that is in at least `hot` documents."""
    shared = docs.sparkSession.sparkContext.broadcast(freq)
    schema = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("n", pa.int32()), ("first", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("p", pa.int32()), ("token", pa.int64())])
    very = freq.keys[freq.counts >= hot]

    def out(**cols) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)

    def pack(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) for _, _, x in rows]
        if len(very):
            wide = [np.isin(x, very) for _, _, x in rows]
            for (i, n, x), on, size in zip(rows, wide, sizes):
                if on.any():
                    yield out(kind=["h"] * int(on.sum()), id=[i] * int(on.sum()), n=[n] * int(on.sum()), p=[size] * int(on.sum()), token=x[on].view(np.int64))
            rows = [(i, n, x[~on]) for (i, n, x), on in zip(rows, wide)]
        head = np.array([(i, n, size) for (i, n, _), size in zip(rows, sizes)], np.int64)
        table = zlib.compress(np.ascontiguousarray(head.T).tobytes(), 1)
        tokens = np.concatenate([x for _, _, x in rows])
        who = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(x) for _, _, x in rows])
        order = np.argsort(tokens)
        tokens, who = tokens[order], who[order]
        bucket = (_mix(tokens) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tokens, who, bucket = tokens[order], who[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        kept = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        size = len(table).to_bytes(4, "little")
        yield out(kind=["p"] * len(kept), bucket=kept, blob=[size + table + tokens[cuts[b] : cuts[b + 1]].tobytes() + who[cuts[b] : cuts[b + 1]].tobytes() for b in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, firsts, rows, held = shared.value, {}, [], 0
        for ids, texts in common.rows_of(batches, "id", "text"):
            for some, sets in _in_pieces(ids, texts):
                first = []
                for i, x in zip(some, sets):
                    other = None
                    if len(x) and i is not None:
                        other = firsts.setdefault(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), i)
                        if other == i:
                            p = f.prefix(x)
                            rows.append((i, len(x), p))
                            held += len(p)
                    first.append(other)
                yield out(kind=["d"] * len(some), id=some, n=[len(x) for x in sets], first=first)
                if held >= flush:
                    yield from pack(rows)
                    rows, held = [], 0
        if rows:
            yield from pack(rows)

    return docs.mapInArrow(run, _PARTS)


def _counted(a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of places, by id, with how often they come and how often they must; pairs of too different sizes go."""
    ok = (ids[a] != ids[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
    a, b = a[ok], b[ok]
    swap = ids[a] > ids[b]
    a, b = np.where(swap, b, a).astype(np.uint64), np.where(swap, a, b).astype(np.uint64)
    key, count = np.unique((a << np.uint64(32)) | b, return_counts=True)
    a, b = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return ids[a], ids[b], count, least_shared(n[a], n[b], p[a], p[b])


_LISTS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int32()), ("needed", pa.int32()), ("brief", pa.int32()), ("token", pa.int64()), ("hub", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("p", pa.int32())])


def _lists(table: pa.Table) -> pa.Table:
    """A bucket's posting lists: pairs (a, b, shared, needed, brief) of short lists and of hubs, brief being the part of shared
    from short lists; and the postings of long lists."""
    ids, ns, ps, tokens, who, base = [], [], [], [], [], 0
    for blob in table["blob"]:
        raw = blob.as_py()
        size = int.from_bytes(raw[:4], "little")
        head = np.frombuffer(zlib.decompress(raw[4 : 4 + size]), np.int64).reshape(3, -1)
        count = (len(raw) - 4 - size) // 12
        tokens.append(np.frombuffer(raw, np.uint64, count, 4 + size))
        who.append(np.frombuffer(raw, np.uint32, count, 4 + size + 8 * count).astype(np.int64) + base)
        ids.append(head[0]), ns.append(head[1]), ps.append(head[2])
        base += head.shape[1]
    ids, ns, ps, tokens, who = map(np.concatenate, (ids, ns, ps, tokens, who))
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    cut = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    size = np.diff(np.concatenate([cut, [len(tokens)]]))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(size[(size > 1) & (size <= SHORT)]):
        rows = who[cut[size == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        left.append(rows[:, i].ravel()), right.append(rows[:, j].ravel())
    brief = len(left)
    rank = _mix(ids.view(np.uint64))
    long = np.flatnonzero(size > SHORT)
    spots, hubs = [], []
    for k in long:
        members = who[cut[k] : cut[k] + size[k]]
        hub = members[np.argmin(rank[members])]
        left.append(np.full(len(members), hub)), right.append(members)
        spots.append(np.arange(cut[k], cut[k] + size[k])), hubs.append(np.full(len(members), ids[hub]))
    counts = [_counted(np.concatenate(x), np.concatenate(y), ids, ns, ps) for x, y in ((left[:brief], right[:brief]), (left[brief:], right[brief:])) if x]
    a, b, count, needed = (np.concatenate([x[j] for x in counts]) for j in range(4))
    short = np.where(np.arange(len(a)) < len(counts[0][0]), count, 0)
    at = np.concatenate(spots) if spots else np.zeros(0, np.int64)
    pairs = [pa.array(a), pa.array(b), pa.array(count, pa.int32()), pa.array(needed, pa.int32()), pa.array(short, pa.int32())]
    posts = [pa.array(tokens[at].view(np.int64)), pa.array(np.concatenate(hubs) if hubs else at), pa.array(ids[who[at]]), pa.array(ns[who[at]], pa.int32()), pa.array(ps[who[at]], pa.int32())]
    one = pa.Table.from_arrays([*pairs, *[pa.nulls(len(a), t) for t in _LISTS.types[5:]]], schema=_LISTS)
    two = pa.Table.from_arrays([*[pa.nulls(len(at), t) for t in _LISTS.types[:5]], *posts], schema=_LISTS)
    return pa.concat_tables([one, two])


_NEAR = pa.schema([("hub", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("id", pa.int64()), ("component", pa.int64()), ("part", pa.int32())])


def _hubs(table: pa.Table, names: tuple[str, ...]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
    """The rows of each hub of the table, and of these the named columns."""
    table = table.sort_by("hub")
    hub = table["hub"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
    for at, end in zip(cuts, [*cuts[1:], len(hub)]):
        part = table.slice(at, end - at)
        yield part, {c: part[c].to_numpy().astype(np.int64) for c in names}


def _sides(part: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Places on both sides of a tile: of blocks lo and hi if these differ, else all on both."""
    return [np.flatnonzero(part == x) if lo != hi else np.arange(len(part)) for x in (lo, hi)]


def _tile(table: pa.Table) -> pa.Table:
    """Documents of a tile that may be over the threshold with one of another component, for each hub of the table. Of each
    document, `postings` are all its places in open lists, and `brief` is the most that it shares with one other set in short
    lists; a pair that cannot reach its count with these is not over the threshold. A document comes once, whatever the number
    of its pairs."""
    out = []
    for _, cols in _hubs(table, ("hub", "token", "id", "n", "p", "component", "postings", "brief", "part", "lo", "hi")):
        token, ids, n, p, comp, postings, brief, part = (cols[c] for c in ("token", "id", "n", "p", "component", "postings", "brief", "part"))
        hub, lo, hi = (int(cols[c][0]) for c in ("hub", "lo", "hi"))
        if (comp == comp[0]).all():
            continue
        _, first, place = np.unique(np.stack([ids, n, p]), axis=1, return_index=True, return_inverse=True)  # one place for each set
        place = place.ravel()
        ids, n, p, comp, brief, part = (x[first] for x in (ids, n, p, comp, brief, part))
        rest = postings[first] - np.bincount(place, minlength=len(first))
        left, right = _sides(part, lo, hi)
        _, code = np.unique(token, return_inverse=True)
        shared = np.zeros((len(left), len(right)), np.float32)
        for base in range(0, code.max() + 1, BLOCK):
            some = (code >= base) & (code < base + BLOCK)
            grid = np.zeros((len(ids), BLOCK), np.float32)
            np.add.at(grid, (place[some], code[some] - base), 1)
            shared += grid[left] @ grid[right].T
        near = np.zeros(len(ids), bool)
        for k in range(0, len(left), 128):
            i, j = np.nonzero(shared[k : k + 128])
            i, j, count = left[k + i], right[j], shared[k + i, j].astype(np.int64)
            ok = (comp[i] != comp[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
            i, j, count = i[ok], j[ok], count[ok]
            able = count + np.minimum(rest[i], rest[j]) + np.minimum(brief[i], brief[j]) >= least_shared(n[i], n[j], p[i], p[j])
            near[i[able]] = near[j[able]] = True
        _, at = np.unique(np.where(near, ids, ids.min() - 1), return_index=True)  # an id with several sets comes once
        at = at[near[at]]
        out.append(pa.Table.from_arrays([pa.array(np.full(len(at), x), t) for x, t in zip((hub, lo, hi), _NEAR.types)] + [pa.array(x[at], t) for x, t in zip((ids, comp, part), _NEAR.types[3:])], schema=_NEAR))
    return pa.concat_tables(out) if out else _NEAR.empty_table()


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at left with those at right. Shingles of up to SHORT sets add their pairs, others
    go through products of small matrices; beside the sizes, only pieces of a few megabytes are held."""
    tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    cut = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([cut, [len(tokens)]]))
    del tokens, order
    row, col = (np.full(len(sets), -1, np.int32) for _ in range(2))
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.int32)
    for k in np.unique(size[(size > 1) & (size <= SHORT)]):
        i, j = (x.astype(np.int32) for x in np.nonzero(~np.eye(k, dtype=bool)))
        some = cut[size == k]
        for at in range(0, len(some), step := max(1, (1 << 16) // len(i))):
            rows = who[some[at : at + step, None] + np.arange(k)]
            x, y = row[rows[:, i].ravel()], col[rows[:, j].ravel()]
            ok = (x >= 0) & (y >= 0)
            np.add.at(total, (x[ok], y[ok]), 1)
    long = np.flatnonzero(size > SHORT)
    for base in range(0, len(long), 256):
        some = long[base : base + 256]
        grid = np.zeros((len(sets), len(some)), np.float32)
        for k, c in enumerate(some):
            grid[who[cut[c] : cut[c] + size[c]], k] = 1
        one, other = grid[left], grid[right].T
        for k in range(0, len(left), 128):
            total[k : k + 128] += (one[k : k + 128] @ other).astype(np.int32)
    return total


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(table: pa.Table) -> pa.Table:
    """Links of a tile that join the same documents as all its links between components do, for each hub of the table: a
    spanning forest, so fewer than the tile has documents. All pairs are compared by their whole sets."""
    out = []
    for rows, cols in _hubs(table, ("id", "component", "part", "lo", "hi")):
        ids, comp, part = (cols[c] for c in ("id", "component", "part"))
        column = rows["s"].combine_chunks()
        values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
        sets = np.split(values, ends[:-1])
        n = np.diff(np.concatenate([[0], ends])).astype(np.int64)
        left, right = _sides(part, int(cols["lo"][0]), int(cols["hi"][0]))
        both = _overlaps(sets, left, right)
        link = np.zeros((len(ids), len(ids)), bool)
        for k in range(0, len(left), 128):
            i, some = left[k : k + 128], both[k : k + 128].astype(np.int64)
            link[np.ix_(i, right)] = (some > 0) & (100 * some >= 75 * (n[i][:, None] + n[right] - some)) & (comp[i][:, None] != comp[right])
        link |= link.T
        a, b, fresh = [], [], link.any(axis=1)
        while fresh.any():
            todo = [int(np.argmax(fresh))]
            fresh[todo[0]] = False
            while todo:
                i = todo.pop()
                more = np.flatnonzero(link[i] & fresh)
                fresh[more] = False
                a.append(np.full(len(more), ids[i])), b.append(ids[more])
                todo += more.tolist()
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            out.append(pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_LINKS))
    return pa.concat_tables(out) if out else _LINKS.empty_table()


def _tiled(docs: DataFrame, open_lists: DataFrame, in_short: DataFrame, buckets: int, block: int, salt: int, across: bool) -> tuple[DataFrame, int]:
    """(links of open lists that unite what all links do, number of hubs that were dealt). Hubs with more than `block` documents
    are dealt into blocks; across, all pairs of blocks meet, else each meets itself. Smaller hubs share a task for each bucket."""
    places = open_lists.groupBy("id").agg(F.count("*").alias("postings"))
    large = common.stored(open_lists.groupBy("hub").agg(F.approx_count_distinct("id", 0.02).alias("d")).where(F.col("d") > block).select("hub", F.ceil(F.col("d") / block).cast("int").alias("blocks")))
    dealt = large.count()
    if dealt <= 100_000:  # 12 bytes each; more are joined by a shuffle
        large = F.broadcast(large)
    bounded = open_lists.join(places, "id").join(in_short, "id", "left").join(large, "hub", "left").withColumn("brief", F.coalesce("brief", F.lit(0)).cast("long"))
    bounded = bounded.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    if across:
        bounded = bounded.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    else:
        bounded = bounded.withColumn("other", F.col("part"))
    tile = F.when(F.col("blocks").isNotNull(), F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(buckets)))
    keyed = bounded.select("hub", "token", "id", "n", "p", "component", "postings", "brief", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), tile.alias("tile"), F.col("blocks").isNotNull().alias("alone"))
    near = common.stored(keyed.groupBy("alone", "tile", "lo", "hi").applyInArrow(lambda t: _tile(t), "hub long, lo int, hi int, id long, component long, part int"))
    # sets are longer than their postings here, so small hubs share ever smaller buckets
    tile = F.when(F.col("blocks").isNotNull(), F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(16 * buckets)))
    held = near.join(large, "hub", "left").select("hub", "lo", "hi", "id", "component", "part", tile.alias("tile"), F.col("blocks").isNotNull().alias("alone")).join(_sets(docs, near), "id")
    return held.groupBy("alone", "tile", "lo", "hi").applyInArrow(lambda t: _linked(t), "a long, b long").distinct(), dealt


def _hot_lists(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with hubs, postings) of postings (token, id, n, p) that are too many to gather: a hub is an aggregate, one for each
    token, and there are no more of these than Frequent keeps."""
    least = F.min(F.struct(F.xxhash64("id").alias("r"), F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("p").alias("hub_p")))
    hubs = hot.groupBy("token").agg(least.alias("x")).select("token", "x.hub", "x.hub_n", "x.hub_p")
    rows = common.stored(hot.join(F.broadcast(hubs), "token"))
    needed = F.greatest(F.lit(1), F.expr("(3 * (n + hub_n) + 6) DIV 7") - F.greatest(F.col("n") - F.col("p"), F.col("hub_n") - F.col("hub_p")))
    near = rows.where("id <> hub AND 4 * least(n, hub_n) >= 3 * greatest(n, hub_n)")
    pairs = near.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.lit(1).alias("shared"), needed.cast("int").alias("needed"), F.lit(0).alias("brief"))
    return pairs, rows.select("token", "hub", "id", "n", "p")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the sets of the documents with these ids, and of a few more. A filter of fixed size thins the texts before they
    are hashed again."""
    bits = common.bit_filter(ids.select("id"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.rows_of(batches, "id", "text"):
            for some, sets in _in_pieces(ids, texts):
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "s"])

    return common.stored(common.passing(docs.where("id is not null"), "id", bits).mapInArrow(run, "id long, s array<bigint>"))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""
    sets = _sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= 75 * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def _united(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component) with the components that links (a, b) join made one: only components are gone through again."""
    for c in ("a", "b"):
        links = links.join(found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component")), c, "left").withColumn(c, F.coalesce(f"{c}_component", c))
    more = common.stored(components(links.select("a", "b")))
    moved = found.join(more.select(F.col("id").alias("component"), F.col("component").alias("new")), "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    return common.stored(moved.unionByName(more.join(found, "id", "left_anti")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the least id reachable by links, itself included).

    Words are runs of other bytes than white space, A-Z in lower case. A text of fewer than five words is one shingle; without
    a word, or null, it has none and links with nothing. Rows that repeat an id are one node with all their texts. A null id
    has component_id null and links with nothing. An empty table gives no rows. Other columns are not read.
    Shingles are compared by 64-bit hashes: two different ones inside a pair agree with a chance of about n^2 / 2^64.
    hot: shingles in so many documents are not gathered by one task; block: documents that meet in one tile. Both change costs only.
    """
    spark = docs.sparkSession
    base = common.texts(docs, id_col, text_col)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    freq = frequent(base)
    parts = common.stored(_index(base, freq, buckets, hot), "kind")
    rows = parts.where("kind = 'd'").select("id", "n", "first")
    packed = parts.where("kind = 'p'").select("bucket", "blob")
    schema = "a long, b long, shared int, needed int, brief int, token long, hub long, id long, n int, p int"
    lists = common.stored(packed.groupBy("bucket").applyInArrow(lambda t: _lists(t), schema))
    pairs, posts = lists.where("a is not null").select("a", "b", "shared", "needed", "brief"), lists.where("token is not null").select("token", "hub", "id", "n", "p")
    if (freq.counts >= hot).any():
        more_pairs, more_posts = _hot_lists(parts.where("kind = 'h'").select("token", "id", "n", "p"))
        pairs, posts = pairs.unionByName(more_pairs), posts.unionByName(more_posts)
    near = common.stored(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed"), F.sum("brief").alias("brief")))
    copies = rows.where("first <> id").select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = common.stored(_verified(base, near.where("shared >= needed").select("a", "b")))
    found = common.stored(components(links.unionByName(copies)))
    in_short = near.where("brief > 0").select(F.explode(F.array("a", "b")).alias("id"), "brief").groupBy("id").agg(F.max("brief").alias("brief"))
    # a pair that shares no open list has its whole count in near, so only documents of open lists are compared again
    for salt, across in ((1, False), (2, False), (3, True)):
        marked = posts.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = marked.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
        open_lists = common.stored(marked.join(mixed, "token", "left_semi"))
        more, dealt = _tiled(base, open_lists, in_short, buckets, block, salt, across)
        late = common.stored(more)
        if not late.isEmpty():
            found = _united(found, late)
        if not dealt:  # every pair has met
            break
    return rows.join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM worded
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * COUNT(*) >= 75 * (MIN(x.n) + MIN(y.n) - COUNT(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT doc_id, len(s) AS n_shingles, (SELECT MIN(other) FROM reached r WHERE r.doc_id = sets.doc_id) AS component_id FROM sets
"""
