"""N-gram Jaccard join: a size-aware heavy-light set similarity join, and its components.

A document's set is its distinct 5-word shingles as 64-bit hashes.  Two sets of
sizes s and t are linked when 100 * overlap >= 80 * union, that is when
9 * overlap >= 4 * (s + t).  Equal sets are one class from the start.

Order.  Shingles are ordered by how frequent they are (the most frequent ones, HEAVY of
them at most, found by counting in tasks and adding up) and then by hash.  Any order gives the
same links; this one keeps passages that many documents share out of the prefixes.

Candidates.  With k = 1 or 2, two linked sets share k shingles among the first
s - ceil(0.8 s) + k of each.  Small sets enumerate the subsets of two shingles
of that prefix, large sets scan inverted lists of single shingles; two small sets
meet by subsets, all others by lists.  The boundary is the size at which the cost, subsets
enumerated plus postings and list entries scanned, estimated from the histogram of
sizes, is least.  The first k shared shingles stand at positions i and j, so
min(s - i, t - j) bounds the overlap; pairs that can't reach it are not made.  A posting also names the
shingle before it: where two sets have the same one, an earlier list has them both, and this list doesn't make the pair again.

Lists of up to LONG sets make their pairs.  In longer ones, which come from groups of near copies, each set
meets the list's hubs only: of its own and the neighbouring size ranges, the sets of least hash, by two hashes
(the same in all lists of a group, so that a pair is made once).  What is linked so far is joined into components.
Then only sets of different components still meet, in tiles of about TILE sets of like sizes; tiles whose sizes are too far apart for a link don't meet.  A tile with more than MANY pairs for each of its sets that may
be linked makes at first, for each set, the BEST pairs that the bound below ranks highest (in a star of copies, those with its
centre); with what these have linked, it then makes all that are still apart.
Lists of a shingle that more than SPLIT documents hold are dealt by set to several tasks, with the sets of least hash
in each of them, so the parts have common hubs; their sets meet across parts in the tiles.

Checks.  Each candidate pair must pass a bound by the counts of its shingles in
SIGN hash buckets (the sum of the lesser counts bounds the overlap); for those that do the sets are made
from the texts once more, bounded by counts in about as many buckets as they have shingles (an eighth of the bytes), and what is left
is compared in full.  Of the first pairs, each set's most likely one is compared first; those that are linked by then needn't be.

Cases: null and empty texts, and texts without words, have size 0, no links, and are their own component;
texts of fewer than five words are one shingle, so they link with equal word
sequences only; repeated rows are equal sets and link (a row is a document); null doc_id
takes part, but is never a component's name unless all its rows have none; very long texts are whole;
an empty table gives an empty result.  A class is named by 64 hash bits of its set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisand.llm.components import components
from palisand.llm.shared import finished, looked_up, only, released, remembers, sliced, staged

N = 5
#: Frequent shingles that the order knows by name (16 bytes each are sent to tasks); least count of them.
HEAVY, HEAVY_FROM = 200_000, 20
#: Shingles that a task counts at a time; least count in a task.
AT_ONCE, LOCAL_FROM = 2_000_000, 5
#: Longest list of which all pairs are made at once; sets in a tile of longer ones; postings of a bucket.
LONG, TILE, BUCKET = 4, 2048, 400_000
#: Factor between the sizes of two steps, by which long lists are parted into tiles.
STEP = 1.02
#: Pairs of a set beyond which its rows are dealt to several tasks.
HOT = 50_000
#: Partners that a set of a crowded tile meets at first; pairs for each set from which a tile is crowded.
BEST, MANY = 2, 2
#: Documents with a shingle beyond which its list is dealt to several tasks; hubs that all of them see.
SPLIT, HUBS = 50_000, 64
#: Hash buckets of the bound; size from which it isn't used.
SIGN, WIDE = 256, 65_535
#: Sizes up to which the boundary may lie.
SMALL_MOST = 64

#: key: high half of the key's hash (the bucket holds more of it); before: the shingle before it in the set's order;
#: kind: of an ordinary list, of a part of a split one, or the copy of a hub in another part.
_POSTING = np.dtype([("key", "<u4"), ("before", "<u8"), ("sid", "<i8"), ("n", "<u4"), ("at", "<u4"), ("kind", "u1")])
WHOLE, PART, COPY = 0, 1, 2


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


remembers("shingled words", _words.cache_clear)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: ascending 64-bit hashes."""
    found = (text or "").encode().lower().split()  # of bytes, lower() changes A-Z only and split() parts at ASCII white space only
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_words().__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(N, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - width + 1 + j])
    return np.unique(h)


def set_id(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def signature(s: np.ndarray) -> bytes:
    """Counts of the shingles by hash bucket, a byte each.  Where one is over 255 all are 255, so that the lesser counts
    are the other set's; sets of WIDE shingles and more pass the bound in any case."""
    count = np.bincount((s >> np.uint64(20)).astype(np.int64) % SIGN, minlength=SIGN)
    return (count if count.max() < 256 else np.full(SIGN, 255)).astype(np.uint8).tobytes()


def prefix_size(s: np.ndarray | int) -> np.ndarray | int:
    """Shingles among which a linked set must share one: s - ceil(0.8 s) + 1."""
    return s - (4 * s + 4) // 5 + 1


def _batches(rows: list[list], names: list[str], types: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, types, strict=True)], names)


def described(docs: DataFrame) -> DataFrame:
    """Three kinds of rows: set (doc_id, row, sid, n, sign) of every document (doc_id, row, text), and, of the task's shingles,
    count (sid = shingle, n = count) and total (sid = postings, n = how many others their lists hold)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, types = ["kind", "doc_id", "row", "sid", "n", "sign"], [pa.string(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        held: list[np.ndarray] = []
        size = 0

        def counted():
            all_ = np.sort(np.concatenate(held))
            start = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]])
            c = np.diff(np.r_[start, len(all_)])
            often = c >= LOCAL_FROM
            h = all_[start[often]].view(np.int64).tolist()
            k = len(h)
            return _batches([["count"] * k + ["total"], [None] * (k + 1), [None] * (k + 1), [*h, len(all_)], [*c[often].tolist(), int((c * (c - 1)).sum())], [None] * (k + 1)], names, types)

        only("shingled words")
        for b in sliced(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, row, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingles(text)
                for column, x in zip(rows, ("set", doc_id, row, set_id(s), len(s), signature(s)), strict=True):
                    column.append(x)
                held.append(s)
                size += len(s)
                if size >= AT_ONCE:
                    yield counted()
                    held.clear()
                    size = 0
            yield _batches(rows, names, types)
        if size:
            yield counted()

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"kind string, doc_id {kind.simpleString()}, row long, sid long, n long, sign binary")


class Order:
    """The global order of shingles: frequency class, then hash."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(heavy)
        self.heavy, self.counts = heavy[at], counts[at].astype(np.int64)

    def count(self, s: np.ndarray) -> np.ndarray:
        """How many documents hold each shingle; 0 unless it is a frequent one."""
        if not len(self.heavy):
            return np.zeros(len(s), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.heavy, s), len(self.heavy) - 1)
        return np.where(self.heavy[at] == s, self.counts[at], 0)

    def first(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k shingles of a set, and their counts."""
        count = self.count(s)
        at = np.lexsort((s, np.log2(np.maximum(count, 1)).astype(np.int64)))[:k]
        return s[at], count[at]


def boundary(sizes: dict[int, int], others: float) -> int:
    """The size up to which sets are small: where the estimated cost is least.  sizes: how many sets have each
    size up to SMALL_MOST; others: how many other sets a posting's list holds on average."""
    cost = {}
    for b in range(1, SMALL_MOST + 1):
        subsets = sum(c * prefix_size(s) * (prefix_size(s) + 1) // 2 for s, c in sizes.items() if 2 <= s <= b)
        lists = sum(c * prefix_size(s) * (1 + others) for s, c in sizes.items() if s >= 0.8 * b or s > b)
        cost[b] = subsets + lists
    return min(cost, key=lambda b: (cost[b], b))


def keys_of(s: np.ndarray, sid: int, order: Order, small: int) -> list[tuple[np.ndarray, ...]]:
    """(keys, positions, shingles before them, counts) of a set's postings: subsets of two if it is small, single
    shingles if it can be the partner of a large set or is one.  What is before a subset, or the first shingle, is no other set's."""
    n, p = len(s), int(prefix_size(len(s)))
    found = []
    first, count = order.first(s, p + 1)
    own = np.int64(sid).astype(np.uint64)
    if 2 <= n <= small:
        i, j = np.triu_indices(min(p + 1, n), 1)
        found.append((mixed(first[i] * np.uint64(0x9E3779B97F4A7C15) + first[j]), j - 1, np.full(len(i), own), np.minimum(count[i], count[j])))
    if n > small or 5 * (n + 1) > 4 * (small + 1) and n > 1:
        found.append((first[:p], np.arange(min(p, n)), np.r_[own, first[: p - 1]], count[:p]))
    return found


def dealt(p: np.ndarray, key: np.ndarray, count: np.ndarray, n_buckets: int, split: int, hubs: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings, and the bucket of each.  Those of a key that more than split documents hold go to the part of the
    list that their set's hash names; about hubs of least hash go to all its parts."""
    parts = -(-count // split)
    if (parts <= 1).all():
        return p, (key % np.uint64(n_buckets)).astype(np.int64)
    mix = mixed(p["sid"].copy().view(np.uint64))
    own = np.where(parts > 1, (mix >> np.uint64(8)) % np.maximum(parts, 1).astype(np.uint64), np.uint64(0))
    p["kind"][parts > 1] = PART
    rows, bucket = [p], [(key + own * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_buckets)]
    for i in np.flatnonzero((parts > 1) & (mix.astype(np.float64) * count < hubs * 2.0**64)).tolist():
        copies = np.repeat(p[i : i + 1], parts[i])
        copies["kind"] = COPY
        salt = np.arange(parts[i], dtype=np.uint64)
        rows.append(copies[salt != own[i]])
        bucket.append(((key[i] + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_buckets))[salt != own[i]])
    return np.concatenate(rows), np.concatenate(bucket).astype(np.int64)


def _bucketed(docs: DataFrame, order, small: int, n_buckets: int) -> DataFrame:
    """bucket, block: postings (once per class in each task)."""
    split, hubs = SPLIT, HUBS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        size = 0

        def blocks():
            all_, bucket = dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), n_buckets, split, hubs)
            at = np.argsort(bucket, kind="stable")
            all_, bucket = all_[at], bucket[at]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [x.tobytes() for x in np.split(all_, start[1:])]
            return _batches([bucket[start].tolist(), parts], ["bucket", "block"], [pa.int64(), pa.binary()])

        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                s = shingles(text)
                if len(s) < 2 or (sid := set_id(s)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(sid)
                for key, at, before, count in keys_of(s, sid, order.value, small):
                    rows = np.zeros(len(key), dtype=_POSTING)
                    rows["key"], rows["before"], rows["sid"], rows["n"], rows["at"] = key >> np.uint64(32), before, sid, len(s), at
                    held.append((rows, key, count))
                    size += len(rows)
                if size >= AT_ONCE // 4:
                    yield blocks()
                    held.clear()
                    size = 0
        if size:
            yield blocks()

    return docs.select("text").mapInArrow(run, "bucket long, block binary")


def _possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether first shared positions at and to leave room for enough overlap of sets of sizes n and m."""
    return 9 * np.minimum(n - at, m - to) >= 4 * (n + m)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    changes = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        changes |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, changes])


def list_pairs(p: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's postings: the distinct pairs (sid, sid) to be looked at, and the postings of the lists whose sets have only met hubs."""
    p = p[np.lexsort((p["kind"], p["at"], p["sid"], p["key"]))]
    p = p[_starts(p["key"], p["sid"], p["at"])]
    start = _starts(p["key"])
    length = np.diff(np.r_[start, len(p)])
    # lists whose sets all have the same shingle before this one make nothing
    several = np.logical_or.reduceat(p["before"] != np.repeat(p["before"][start], length), start)
    split = np.logical_or.reduceat(p["kind"] != WHOLE, start)
    some = (length > 1) & several | split
    p, length, split = p[np.repeat(some, length)], length[some], split[some]
    if not len(p):
        return np.empty((0, 2), dtype=np.int64), p
    number, left = np.repeat(np.arange(len(length)), length), np.repeat(length, length)
    place = np.arange(len(p)) - np.repeat(np.cumsum(length) - length, length)
    wide = (left > long) | split[number]
    n, at, sid, before = p["n"].astype(np.int64), p["at"].astype(np.int64), p["sid"], p["before"]
    found = []

    def met(i: np.ndarray, j: np.ndarray) -> None:
        ok = _possible(n[i], at[i], n[j], at[j]) & (before[i] != before[j]) & (sid[i] != sid[j])
        found.append(np.stack([np.minimum(sid[i[ok]], sid[j[ok]]), np.maximum(sid[i[ok]], sid[j[ok]])], axis=1))

    for d in range(1, long):  # each posting with the d-th after it in its list
        i = np.flatnonzero(~wide & (place + d < left))
        met(i, i + d)
    q = np.flatnonzero(wide)
    if len(q):
        group = number[q] * 1024 + np.floor(np.log(np.maximum(n[q], 1)) / np.log(1.25)).astype(np.int64)
        for turn in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15):
            mix = mixed(sid[q].copy().view(np.uint64) * np.uint64(turn))
            by = np.lexsort((mix, group))
            first = by[_starts(group[by])]
            groups, hubs = group[first], q[first]
            for near in (-1, 0, 1):
                to = np.minimum(np.searchsorted(groups, group + near), len(groups) - 1)
                ok = groups[to] == group + near
                met(q[ok], hubs[to[ok]])
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs, p[wide & (p["kind"] != COPY)]


def _from_lists(postings: DataFrame, n_buckets: int) -> DataFrame:
    """kind = pair: sid, other; kind = long: a posting of a list whose sets have only met hubs: key, sid, n, at, before."""
    long = LONG

    def run(rows):
        import pyarrow as pa

        pairs, q = list_pairs(np.concatenate([np.frombuffer(x, dtype=_POSTING) for x in rows["block"].to_pylist()]), long)
        # the parts of a list have one name; any other list is named by its bucket as well
        key = np.where(q["kind"] == WHOLE, (rows["bucket"][0].as_py() + 1) << 32, 0) + q["key"].astype(np.int64)
        k, m = len(pairs), len(q)
        none = lambda j: pa.nulls(j, pa.int64())
        ints = lambda *x: pa.chunked_array([y if isinstance(y, pa.Array) else pa.array(np.ascontiguousarray(y).astype(np.int64)) for y in x], type=pa.int64()).combine_chunks()
        columns = [ints(none(k), key), ints(pairs[:, 0], q["sid"]), ints(pairs[:, 1], none(m)), ints(none(k), q["n"]), ints(none(k), q["at"]), ints(none(k), q["before"].copy().view(np.int64))]
        return pa.table([pa.array(["pair"] * k + ["long"] * m, type=pa.string()), *columns], names=["kind", "key", "sid", "other", "n", "at", "before"])

    return postings.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(run, "kind string, key long, sid long, other long, n long, at long, before long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).filter("a <> b").distinct()


def tiles(found: DataFrame) -> DataFrame:
    """key, step, tile0, tile1, to0, to1: for the sets of each step of size in each list (key, step, part) with several components, the tiles
    they are in and the tiles that hold all sets of up to 5/4 or down to 4/5 of their size; linked sets don't differ by more."""
    steps = found.groupBy("key", "step").agg(F.count("*").alias("c"), F.min("part").alias("p0"), F.max("part").alias("p1"))
    whole, by = Window.partitionBy("key"), Window.partitionBy("key").orderBy("step")  # a row for each step of size
    steps = steps.withColumns({"p0": F.min("p0").over(whole), "p1": F.max("p1").over(whole), "upto": F.sum("c").over(by)}).filter("p0 <> p1")
    steps = steps.withColumns({"tile0": F.floor((F.col("upto") - F.col("c")) / TILE), "tile1": F.floor((F.col("upto") - 1) / TILE)})
    reach = math.ceil(math.log(1.25) / math.log(STEP)) + 1
    return steps.select("key", "step", "tile0", "tile1", F.min("tile0").over(by.rangeBetween(-reach, 0)).alias("to0"), F.max("tile1").over(by.rangeBetween(0, reach)).alias("to1"))


def _met_across(longs: DataFrame, parts: DataFrame, classes: DataFrame, best: int | None) -> DataFrame:
    """Pairs (sid, other) of sets of a long list that are in different components and pass both bounds.  With best, a crowded tile makes the
    best pairs of each set only and a row with its list's key."""
    named = parts.select(F.col("node").alias("sid"), F.col("component").alias("part"))
    found = looked_up(longs, named, "sid", "left", F.col("key")).withColumn("part", F.coalesce("part", "sid"))
    found = found.withColumn("step", F.floor(F.ln("n") / math.log(STEP)))
    found = looked_up(found, staged(tiles(found), "list-sizes"), ["key", "step"], "inner", F.col("sid")).join(classes.select("sid", "sign"), "sid")
    own = F.col("tile0") + F.pmod(F.xxhash64("sid"), F.col("tile1") - F.col("tile0") + 1)
    found = found.withColumn("tile", own).withColumn("to", F.explode(F.sequence("to0", "to1")))
    found = found.select("key", F.least("tile", "to").alias("t0"), F.greatest("tile", "to").alias("t1"), "tile", "sid", "n", "at", "before", "part", "sign")
    many = MANY

    def run(key, rows):
        import pyarrow as pa

        t0, t1 = key[1].as_py(), key[2].as_py()
        tile, sid, n, at, before, part = (rows[c].to_numpy() for c in ("tile", "sid", "n", "at", "before", "part"))
        sign = np.frombuffer(b"".join(rows["sign"].to_pylist()), dtype=np.uint8).reshape(-1, SIGN)
        met: list[tuple[int, np.ndarray, np.ndarray]] = []
        right = np.flatnonzero(tile == t1)
        for i in np.flatnonzero(tile == t0).tolist():
            j = right[(part[right] != part[i]) & (before[right] != before[i]) & ((t0 != t1) | (sid[right] > sid[i]))]
            j = j[_possible(n[j], at[j], n[i], at[i])]
            common = 9 * np.minimum(sign[j], sign[i]).sum(axis=1, dtype=np.int64)
            ok = (common >= 4 * (n[j] + n[i])) | (np.maximum(n[j], n[i]) >= WIDE)
            if ok.any():
                met.append((i, j[ok], common[ok] / (n[j[ok]] + n[i])))
        crowded = best is not None and sum(len(j) for _, j, _ in met) > many * len(sid)
        if crowded:
            met = [(i, j[np.argsort(-rank, kind="stable")[:best]], rank) for i, j, rank in met]
        a = np.repeat(sid[[i for i, _, _ in met]], [len(j) for _, j, _ in met]) if met else np.empty(0, dtype=np.int64)
        b = sid[np.concatenate([j for _, j, _ in met])] if met else a
        extra = 1 if crowded else 0
        columns = [a.tolist() + [None] * extra, b.tolist() + [None] * extra, [None] * len(a) + [key[0].as_py()] * extra]
        return pa.table([pa.array(c, type=pa.int64()) for c in columns], names=["sid", "other", "key"])

    return found.groupBy("key", "t0", "t1").applyInArrow(run, "sid long, other long, key long")


def fine(s: np.ndarray) -> bytes:
    """As signature, in half as many to as many buckets as there are shingles (a power of two); of over 255 in one, all 255."""
    size = max(64, 1 << (len(s).bit_length() - 1))
    count = np.bincount((s >> np.uint64(8)).astype(np.int64) & (size - 1), minlength=size)
    return (count if count.max() < 256 else np.full(size, 255)).astype(np.uint8).tobytes()


def fine_bound(x: bytes, y: bytes) -> int:
    """The most that two sets can share, by their fine signatures; the longer is folded to the shorter's buckets."""
    f, g = (np.frombuffer(z, dtype=np.uint8) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    return int(np.minimum(f, g.reshape(-1, len(f)).sum(axis=0, dtype=np.int64)).sum(dtype=np.int64))


def _sided(pairs: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Staged pairs (a, b) with columns of the table (unique sid) for both, as <column>_a and <column>_b.  Where a set has very
    many pairs (a hub), its rows are dealt to several tasks."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    hubs = pairs.count() > HOT and ends.groupBy("sid").count().agg(F.max("count")).first()[0] > HOT
    for c, other in (("a", "b"), ("b", "a")):
        named = table.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])
        if not hubs:
            pairs = pairs.join(named, c)
            continue
        hot = staged(pairs.groupBy(c).agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select(c), "hubs")
        few = staged(looked_up(named, hot, c, "left_semi"), "hub-sets")
        salt = F.col(other)
        dealt_out = looked_up(looked_up(pairs, hot, c, "left_semi", salt), few, c, "inner", salt, 0)
        pairs = looked_up(pairs, hot, c, "left_anti", salt).join(named, c).unionByName(dealt_out)
    return pairs


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for enough overlap."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SIGN) for i in (4, 5))
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = (9 * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= 4 * (n + m)) | (np.maximum(n, m) >= WIDE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return _sided(staged(pairs, "pairs"), classes, ["n", "sign"]).select("a", "b", "n_a", "n_b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def _near(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: a, b and score of the pairs that pass the finer bound, and sid and s of the sets they are made of."""
    pairs = staged(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = staged(classes.join(wanted, "sid", "left_semi").select("row").distinct(), "wanted")
    picked = looked_up(docs, wanted, "row", "left_semi", F.col("doc_id")).select("text")

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done: set[int] = set()
        for b in sliced(batches):
            rows: list[list] = [[], [], [], []]
            for text in b.column(0).to_pylist():
                s = shingles(text)
                if (sid := set_id(s)) not in done:
                    done.add(sid)
                    for column, x in zip(rows, (sid, len(s), fine(s), s.tobytes()), strict=True):
                        column.append(x)
            yield _batches(rows, ["sid", "n", "f", "s"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    sets = staged(picked.mapInArrow(made, "sid long, n long, f binary, s binary"), "sets")

    def bounded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in sliced(batches):
            most = np.array([fine_bound(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], dtype=np.int64)
            both = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(most / np.maximum(both, 1))], ["a", "b", "score"]).filter(pa.array(9 * most >= 4 * both))

    brief = sets.select("sid", "n", "f").dropDuplicates(["sid"])
    near = staged(_sided(pairs, brief, ["n", "f"]).select("a", "b", "n_a", "n_b", "f_a", "f_b").mapInArrow(bounded, "a long, b long, score double"), "near-pairs")
    released(pairs, wanted)
    return near, sets.select("sid", "s")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, staged."""

    def compared(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in sliced(batches):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, type=pa.bool_()))

    needed = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    single = sets.join(needed, "sid", "left_semi").dropDuplicates(["sid"])
    return staged(_sided(pairs, single, ["s"]).select("a", "b", "s_a", "s_b").mapInArrow(compared, "a long, b long"), "links")


def _joined(links: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Components of links and of the components so far, which are links enough of what was linked before."""
    return components(links if parts is None else links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    for c in ("a", "b"):
        pairs = looked_up(pairs, parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")), c, "left", F.struct("a", "b"))
    return pairs.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, row, sid, n, and of documents that have copies or links: component and keeper (no_id, doc_id, row), its first document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    seen = staged(described(docs), "shingle-sets")
    documents = seen.filter("kind = 'set'")
    heavy = seen.filter("kind = 'count'").groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_FROM).orderBy(F.desc("n"), "sid").limit(HEAVY).toArrow()
    order = spark.sparkContext.broadcast(Order(heavy["sid"].to_numpy().astype(np.int64).view(np.uint64), heavy["n"].to_numpy()))
    total = seen.filter("kind = 'total'").agg(F.coalesce(F.sum("sid"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = {r["n"]: r["c"] for r in documents.filter(F.col("n").between(2, SMALL_MOST)).groupBy("n").agg(F.count("*").alias("c")).collect()}
    small = boundary(sizes, total[1] / max(total[0], 1))
    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total[0] // 4 // BUCKET)

    groups = finished("groups", lambda: _groups(docs, documents, order, small, n_buckets))
    return looked_up(documents.select("doc_id", "row", "sid", "n"), groups, "sid", "left", F.col("row"))


def _groups(docs: DataFrame, documents: DataFrame, order, small: int, n_buckets: int) -> DataFrame:
    """sid, component and keeper of the classes that have several documents or links."""
    # a class: its first document in two orders, and what all its documents have in common
    classes = documents.filter("n > 0").groupBy("sid").agg(
        F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("keeper"), F.min(F.struct("row", "n", "sign")).alias("set")
    )
    classes = staged(classes.select("sid", "size", "keeper", "set.*"), "classes")
    sets = classes.filter("n > 1").select("sid", "row", "n", "sign")
    found = staged(_from_lists(_bucketed(docs, order, small, n_buckets), n_buckets), "candidates")
    longs = found.filter("kind = 'long'").select("key", "sid", "n", "at", "before")
    near, made = _near(docs, sets, _bounded(_ordered(found.filter("kind = 'pair'").select("sid", "other")), sets))
    likely = near.groupBy("b").agg(F.max_by("a", F.struct("score", "a")).alias("a")).select("a", "b")
    parts = _joined(_linked(likely, made), None)
    rest = staged(_apart(near.join(likely, ["a", "b"], "left_anti"), parts), "other-pairs")
    released(near, made)
    across = staged(_met_across(longs, parts, sets, BEST), "across")
    near, made = _near(docs, sets, _ordered(across.filter("sid is not null").select("sid", "other")).unionByName(rest).distinct())
    parts = _joined(_linked(near.select("a", "b"), made), parts)
    released(near, made, rest)
    crowded = staged(across.filter("key is not null").select("key").distinct(), "crowded-lists")
    if not crowded.isEmpty():
        again = _met_across(looked_up(longs, crowded, "key", "left_semi", F.col("sid")), parts, sets, None)
        near, made = _near(docs, sets, _ordered(again.select("sid", "other")))
        parts = _joined(_linked(near.select("a", "b"), made), parts)
    parts = parts.select(F.col("node").alias("sid"), "component")
    groups = classes.select("sid", "size", "keeper").join(parts, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    firsts = groups.groupBy("component").agg(F.min("keeper").alias("keeper"), F.sum("size").alias("size")).filter("size > 1")
    firsts = staged(firsts.select("component", "keeper"), "firsts")
    return looked_up(groups.select("sid", "component"), firsts, "component", "inner", F.col("sid"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, row (64 hash bits of doc_id and text), n_shingles, component_id and component (a number; null without words) of every row."""
    alone = F.col("keeper").isNull()
    return _placed(docs).select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("component"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (nulls last), of equal ones the least row.
    Rows without words all stay."""
    found = staged(_placed(docs).select("row", "n", F.col("keeper.row").alias("stays")), "components")
    gone = found.filter("row <> stays").select("row").distinct()
    again = found.filter("n > 0").groupBy("row").agg(F.count("*").alias("c")).filter("c > 1").select("row")
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))  # whatever the columns of docs are called
    kept = keyed.join(gone, "row", "left_anti")
    if not again.isEmpty():  # rows that are there more than once
        kept = kept.join(again, "row", "left_anti").unionByName(kept.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select("doc.*")
