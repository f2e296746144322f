"""Source divergence audit: how far apart the sources of a language are, and by which terms.

Tasks count terms in byte tries (radix tries: an edge carries eight bytes), one for each language, whose leaves
count documents, and occurrences for each source.  Tries that grow beyond LEAVES are handed out and begun anew, since tries merge.
Its leaves are dealt by ranges of their first bytes; each range's leaves are merged in a trie, and a traversal in order of UTF-8 hands
out the terms that enough documents of the language hold.  A second traversal sums the divergences of pairs of sources and keeps
each source's best terms: within a traversal terms come in order, so a stable sort settles ties.

A term has at most one leaf for each task and flush, however often it occurs.  All numbers are integers: p = 1 + floor(SCALE (count + 2) /
(total + 2 V)) by long division, f = floor((p - q)^2 / (p + q)).  The result has a row for each pair of a language's sources, which is what is asked for.

Cases: null text, lang and source are ''; a group without terms counts with zeros; a language without kept terms has pairs of value 0 and
no terms; a language of one source has no pairs; repeated rows count each; doc_id is not read, nor is any further column; a
text is split whole, and a term may be as long as it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisand.llm.shared import LOOKUP, looked_up, staged

#: Documents of a language that a term needs; terms shown for each group.
MIN_DOCS, SHOWN = 10, 10
SCALE = 1_000_000_000
#: Leaves that a task's tries hold before they are handed out; leaves of a range, before merging; terms in a row of the result; bytes
#: of a leaf that ranges look at; sources up to whose square a task keeps sums.
LEAVES, RANGE, ROW, HEAD, SQUARE = 600_000, 100_000, 500, 8, 1000
#: Bytes of text that are cut into terms at once; edges of eight bytes on a path.
SLICE, DEPTH = 8 << 20, 8
#: What each byte becomes: letters lower case, all other ASCII characters a space.
TABLE = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(value[order], first) if len(first) else value[:0]


def eights(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The eight bytes from start on as a number that sorts like them, zeros behind the end; data has eight bytes to spare."""
    out = np.zeros(len(start), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | np.where(j < size, data[start + j], 0).astype(np.uint64)
    return out


class Trie:
    """Terms as paths: an edge carries eight bytes (after DEPTH of them, all that is left), and a level's nodes are arrays, in order of parents and
    then of edges.  A node may end a term and have children.  Terms have no byte 0.

    A trie is made of many strings at once, level by level, and tries merge by being made anew of their terms.  leaf: for each string its
    leaf, numbered as a traversal in order of bytes meets them."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.parents: list[np.ndarray] = []
        self.edges: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        node, ended, alive = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.arange(len(start))
        while len(alive):
            depth, at = len(self.edges), start[alive]
            done, left = 8 * depth, size[alive] - 8 * depth
            if depth < DEPTH:
                names, edge = np.unique(eights(data, at + done, left), return_inverse=True)
            else:
                tails = np.empty(len(alive), object)
                tails[:] = [data[i : i + n].tobytes() for i, n in zip((at + done).tolist(), left.tolist())]  # noqa: B905
                names, edge = np.unique(tails, return_inverse=True)
            found, own = np.unique(node[alive] * len(names) + edge, return_inverse=True) if depth else (np.arange(len(names)), edge)
            node[alive], ended[alive] = own, depth
            self.parents.append(found // len(names))
            self.edges.append(names[found % len(names)])
            last = np.zeros(len(found), bool)
            stops = (left <= 8) | (depth == DEPTH)
            last[own[stops]] = True
            self.ends.append(last)
            alive = alive[~stops]
        self.first = self._places()
        self.leaf = np.zeros(len(start), np.int64)
        for depth, first in enumerate(self.first):
            here = ended == depth
            self.leaf[here] = first[node[here]]

    def _places(self) -> list[np.ndarray]:
        """For each level's nodes the number of leaves before them in the traversal."""
        sizes: list[np.ndarray] = []
        for depth in reversed(range(len(self.edges))):
            below = np.bincount(self.parents[depth + 1], sizes[-1], len(self.edges[depth])).astype(np.int64) if sizes else 0
            sizes.append(self.ends[depth] + below)
        first: list[np.ndarray] = []
        for depth, size in enumerate(reversed(sizes)):
            parent = self.parents[depth]
            before = np.cumsum(size) - size
            eldest = np.maximum.accumulate(np.where(np.r_[True, parent[1:] != parent[:-1]], np.arange(len(parent)), 0))
            above = first[-1][parent] + self.ends[depth - 1][parent] if depth else 0
            first.append(above + before - before[eldest])
        return first

    def __len__(self) -> int:
        return int(sum(x.sum() for x in self.ends))

    def terms(self) -> list[bytes]:
        """In order of their bytes: the traversal, a level at a time."""
        out, prefix = np.empty(len(self), object), np.zeros((1, 0), np.uint8)
        for depth, edge in enumerate(self.edges):
            prefix = prefix[self.parents[depth]]
            last = self.ends[depth]
            if depth == DEPTH:
                out[self.first[depth]] = [a.tobytes() + b for a, b in zip(prefix, edge)]  # noqa: B905
            else:
                prefix = np.hstack([prefix, edge.astype(">u8").view(np.uint8).reshape(-1, 8)])
                out[self.first[depth][last]] = prefix[last].view(f"S{prefix.shape[1]}").ravel().tolist()
        return out.tolist()


def _strings(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings or binaries, and where each begins and how long it is."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if "large" in str(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at[:-1] - at[0], np.diff(at)


def _terms_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of a column of texts, and the start, length and row of each term."""
    raw, start, size = _strings(column)
    data = TABLE[raw]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = ~inside
    ends[1:] &= inside[:-1]
    ends[0] = False
    cut = start[(start > 0) & (start < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]  # a text ends in a term, and the next begins with one
    begins[cut] = ends[cut] = True
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    return data, first, last - first, np.searchsorted(start + size, first, side="right")


@dataclass
class Counted:
    """Terms in order, their documents, and occurrences by source: count of source (a number in names) for the term of this number."""

    terms: list[bytes]
    docs: np.ndarray
    term: np.ndarray
    source: np.ndarray
    count: np.ndarray


def merged(parts: list[Counted], n_sources: int) -> Counted:
    """One trie of all terms, its leaf counters summed."""
    if len(parts) == 1:
        return parts[0]
    size = np.fromiter((len(t) for x in parts for t in x.terms), np.int64)
    data = np.frombuffer(b"".join(t for x in parts for t in x.terms), np.uint8)
    trie = Trie(data, np.cumsum(size) - size, size)
    shift = np.cumsum([0] + [len(x.terms) for x in parts])
    docs = np.zeros(len(trie), np.int64)
    np.add.at(docs, trie.leaf, np.concatenate([x.docs for x in parts]))
    owner = trie.leaf[np.concatenate([x.term + s for x, s in zip(parts, shift)])]  # noqa: B905
    key, count = summed(owner * n_sources + np.concatenate([x.source for x in parts]), np.concatenate([x.count for x in parts]))
    return Counted(trie.terms(), docs, key // n_sources, key % n_sources, count)


def _lists(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of n owners begin, owners being in order, the end last."""
    return np.searchsorted(owner, np.arange(n + 1))


def _counted(batches: Iterator) -> Iterator:
    """Leaves of the tries of a task's documents (lang, source, text)."""
    import pyarrow as pa

    names: dict[str, int] = {}
    held: dict[str, list[Counted]] = defaultdict(list)

    def out():
        known = pa.array(list(names), pa.string())
        for lang, parts in sorted(held.items()):
            x = merged(parts, len(names))
            n = len(x.terms)
            at = pa.array(_lists(x.term, n), pa.int32())
            lists = [pa.ListArray.from_arrays(at, v) for v in (known.take(pa.array(x.source)), pa.array(x.count, pa.int64()))]
            table = pa.Table.from_arrays([pa.array([lang] * n, pa.string()), pa.array(x.terms, pa.binary()), pa.array(x.docs, pa.int64()), *lists], ["lang", "term", "docs", "sources", "counts"])
            yield from table.to_batches(max_chunksize=20_000)
        held.clear()
        names.clear()

    for batch in batches:
        done, upto = 0, np.cumsum(_strings(batch.column(2))[2]) if len(batch) else np.zeros(0)
        while done < len(batch):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + SLICE, side="right")))
            part = batch.slice(done, end - done)
            done = end
            data, start, size, row = _terms_of(part.column(2))
            source = np.array([names.setdefault(s, len(names)) for s in part.column(1).to_pylist()])
            lang = part.column(0).dictionary_encode()
            of_row = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = np.flatnonzero(of_row[row] == k)
                if len(own):
                    trie = Trie(data, start[own], size[own])
                    n = len(trie)
                    docs = np.bincount(np.unique(row[own] * n + trie.leaf) % n, minlength=n)
                    key, count = np.unique(trie.leaf * len(names) + source[row[own]], return_counts=True)
                    held[name].append(Counted(trie.terms(), docs, key // len(names), key % len(names), count))
            if sum(len(x.terms) for parts in held.values() for x in parts) > LEAVES:
                for name, parts in held.items():
                    held[name] = [merged(parts, len(names))]
                if sum(len(x.terms) for parts in held.values() for x in parts) > LEAVES // 2:
                    yield from out()
    yield from out()


def _merged(least: int):
    """Merges the leaves of a range and hands out the terms of at least so many documents, ROW of them in a row, in order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute

        table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))], ["lang", "term", "docs", "sources", "counts"])])
        types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
        for lang in sorted(table.column("lang").unique().to_pylist()):
            rows = table.filter(pa.compute.equal(table.column("lang"), lang)).combine_chunks()
            sources = rows.column("sources").combine_chunks()
            named = pa.compute.list_flatten(sources).dictionary_encode()
            owner = np.repeat(np.arange(len(rows)), pa.compute.list_value_length(sources).to_numpy())
            counts = pa.compute.list_flatten(rows.column("counts").combine_chunks()).to_numpy()
            own = Counted(rows.column("term").to_pylist(), rows.column("docs").to_numpy(), owner, named.indices.to_numpy().astype(np.int64), counts)
            none = Counted([], np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3)
            x, names = merged([own, none], max(1, len(named.dictionary))), named.dictionary
            number = np.cumsum(x.docs >= least) - 1
            good = x.docs[x.term] >= least
            terms = [t.decode() for t, d in zip(x.terms, x.docs.tolist()) if d >= least]  # noqa: B905
            term, source, count = number[x.term[good]], x.source[good], x.count[good]
            for a in range(0, len(terms), ROW):
                i, j = np.searchsorted(term, [a, a + ROW])
                cells = (lang, terms[a : a + ROW], (term[i:j] - a).tolist(), names.take(pa.array(source[i:j])).to_pylist(), count[i:j].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, types)], ["lang", "terms", "at", "sources", "counts"])  # noqa: B905

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, terms, at, sources, counts: rows of a language's kept terms in order; counts[i] occurrences of terms[at[i]] in sources[i]."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    leaves = staged(docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, "lang string, term binary, docs long, sources array<string>, counts array<long>"), "leaves")
    ranges = max(1, -(-leaves.count() // RANGE))
    return leaves.repartitionByRange(ranges, "lang", F.substring("term", 1, HEAD)).mapInArrow(_merged(min_docs), "lang string, terms array<string>, at array<int>, sources array<string>, counts array<long>")


def smoothed(counts: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 v)), exact for totals below 2^53."""
    rest, under, out = counts + 2, total + 2 * v, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // under
        rest = rest % under
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _compared(shown: int):
    """part, lang, source, item, value: sums of pairs (source before item) and each source's best terms, of the rows of a task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["part", "lang", "source", "item", "value"]
        sums: dict[str, tuple[list, np.ndarray]] = {}
        best: dict[tuple[str, str], list] = defaultdict(list)

        def pairs(lang, known, a, row):
            k = len(row)
            return pa.RecordBatch.from_arrays([pa.array(["pair"] * k), pa.array([lang] * k), pa.array([known[a]] * k), pa.array(known[a + 1 :]), pa.array(row, pa.int64())], names)

        for b in batches:
            for lang, terms, at, sources, counts, known, totals, v in zip(*(b.column(i).to_pylist() for i in range(8))):  # noqa: B905
                place = {s: i for i, s in enumerate(known)}
                c = np.zeros((len(terms), len(known)), np.int64)
                c[at, [place[s] for s in sources]] = counts
                totals = np.array(totals, np.int64)
                p = smoothed(c, totals, v)
                for a in range(len(known) - 1):
                    row = divergence(p[:, a, None], p[:, a + 1 :]).sum(axis=0)
                    if len(known) > SQUARE:
                        yield pairs(lang, known, a, row)
                    else:
                        sums.setdefault(lang, (known, np.zeros((len(known), len(known)), np.int64)))[1][a, a + 1 :] += row
                q = smoothed(c.sum(axis=1), totals.sum(), v)[:, None]
                value = np.where((c > 0) & (p > q), divergence(p, q), -1)
                for a in np.flatnonzero((value >= 0).any(axis=0)).tolist():
                    own = value[:, a]
                    top = np.argsort(-own, kind="stable")[:shown]
                    found = best[lang, known[a]] + [(-int(own[i]), terms[i]) for i in top if own[i] >= 0]
                    best[lang, known[a]] = sorted(found, key=lambda x: (x[0], x[1].encode()))[:shown]
        for lang, (known, m) in sums.items():
            for a in range(len(known) - 1):
                yield pairs(lang, known, a, m[a, a + 1 :])
        flat = [("term", lang, s, t, -n) for (lang, s), x in best.items() for n, t in x]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat)], names)  # noqa: B905

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, shown: int = SHOWN) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every group of a language and a source."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()  # reads these two columns only
    kept = staged(kept_terms(docs, min_docs), "kept-terms")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    v = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    groups = staged(groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g")).join(v, "lang")
    by_lang = staged(by_lang.select("lang", F.col("g.source").alias("known"), F.col("g.n").alias("totals"), "v"), "languages")
    few = LOOKUP if groups.count() <= LOOKUP else 0  # as many names as there are groups would be sent
    met = looked_up(kept, by_lang, "lang", "inner", F.col("terms"), few).select("lang", "terms", "at", "sources", "counts", "known", "totals", "v")
    parts = staged(met.mapInArrow(_compared(shown), "part string, lang string, source string, item string, value long"), "divergences")
    added = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").filter("source < item").join(added, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = parts.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= shown)
    return both.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
