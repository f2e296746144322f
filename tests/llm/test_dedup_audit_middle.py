"""Exact dedup, source divergence audit and fill-in-middle against brute force and on edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisand.llm import exact_dedup, fill_in_middle, source_audit
from palisand.llm.shared import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, digest string, `group` string, row long, n long, h1 string"
WORDS = "the quick brown fox Jumps over Été ÉTÉ 漢字 漢 straße zebra zebras z \U0001f600x a1b2 don't".split()
PROSE = [" ".join(random.Random(i).choices(WORDS, k=40)) for i in range(60)]
TEXTS = [None, "", " \n", "<P>", "a<S>b", "x" * 70_000, "漢" * 9_000, "é", "<", "<<S", "P>", *PROSE, *PROSE[:9], "", None, PROSE[0] + "\n"]


def documents(spark, texts=TEXTS, langs=("en", None, "fr"), sources=("s0", None, "s2", "s10")):
    rows = [(i if i % 13 != 3 else None, t, langs[i % len(langs)], sources[i % len(sources)], "clash", "clash", 7, 7, "clash") for i, t in enumerate(texts)]
    rows += rows[11:14] + rows[11:12]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def index(spark):
    folder = new_folder(spark, "test-index")
    made = exact_dedup.DigestIndex(spark, "test_" + folder.rpartition("-")[2], folder, buckets=3)
    yield made
    made.drop()


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("share", [1000, 20, 1])
def test_exact_dedup(spark, index, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "SHARE", share)  # at 1 no group is large, at 1000 all
    docs = documents(spark)
    rows = exact_dedup.ledger(docs, "one")
    index.add(rows)
    index.add(rows)  # a delivery that comes again adds nothing
    assert index.rows().count() == len({sha(t) for t in TEXTS})
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[sha(r.text)].append(r.doc_id)
    want = collections.Counter()
    for name, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            want[i, keep, len(ids), k == 0, name] += 1
    assert collections.Counter(map(tuple, exact_dedup.decisions(rows, index).collect())) == want


def test_exact_dedup_over_deliveries(spark, index):
    first, second = documents(spark, TEXTS[:30]), documents(spark, TEXTS[20:] + ["new"])
    a, b = exact_dedup.fresh(first, index, "first"), exact_dedup.fresh(second, index, "second")
    assert a.columns == first.columns and b.columns == second.columns
    texts = [r.text or "" for r in a.collect()] + [r.text or "" for r in b.collect()]
    assert sorted(texts) == sorted({t or "" for t in TEXTS} | {"new"})
    assert exact_dedup.fresh(second, index, "third").count() == 0
    assert sorted(r.text or "" for r in exact_dedup.fresh(second, index, "second").collect()) == sorted(r.text or "" for r in b.collect())  # the same delivery again
    assert exact_dedup.fresh(spark.createDataFrame([], SCHEMA), index, "fourth").count() == 0


def test_index_is_read_without_a_shuffle_and_reopened(spark, index):
    index.add(exact_dedup.ledger(documents(spark), "one"))
    again = exact_dedup.DigestIndex(spark, index.table, index.folder)
    assert again.buckets == 3
    found = exact_dedup.ledger(documents(spark), "two").groupBy("digest").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        plan = found.join(again.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    physical = plan.partition("== Physical Plan ==")[2]
    assert "SortMergeJoin" in physical and physical.count("Exchange hashpartitioning") == 1


def test_ids_that_are_strings(spark):
    docs = documents(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    folder = new_folder(spark, "test-index")
    index = exact_dedup.DigestIndex(spark, "test_" + folder.rpartition("-")[2], folder, id_type="string")
    assert exact_dedup.fresh(docs, index, "one").count() == len({t or "" for t in TEXTS})
    index.drop()
    assert fill_in_middle.transform(docs).count() == docs.count()


# --- fill-in-middle


def middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [1, 500, 8 << 20])
def test_fill_in_middle(spark, monkeypatch, size):
    monkeypatch.setattr(fill_in_middle, "SLICE", size)
    docs = documents(spark, TEXTS * 3)
    out = fill_in_middle.transform(docs)
    got = collections.Counter(map(tuple, out.collect()))
    assert got == collections.Counter((r.doc_id, *middle(r.doc_id, r.text)) for r in docs.collect())
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_restored_is_exact_where_sentinels_almost_occur(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("<PSM>é", k=rng.randint(1, 9))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = fill_in_middle.transform(docs)
    assert {r.doc_id: r.text for r in out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()} == dict(enumerate(texts))
    assert sum(r.form != "plain" for r in out.collect()) > 300


@pytest.mark.parametrize("text", ["", "a", "é" * 700, "漢字 and ascii " * 300, "\U0001f600" * 129, "x" * 64, "x" * 512, "x" * 513])
def test_rank_and_select(text):
    raw = text.encode()
    marks = fill_in_middle.Boundaries(np.frombuffer(raw, np.uint8))
    begin = np.array([len(text[:i].encode()) for i in range(len(text))], np.int64)
    places = np.arange(len(raw) + 1)
    assert np.array_equal(marks.rank(places), np.searchsorted(begin, places))
    assert np.array_equal(marks.select(np.arange(len(text))), begin)
    assert marks.rank(np.array([len(raw)]))[0] == len(text)


# --- source divergence audit


def audited(rows, least=10, shown=10):
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    said, held, out = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        said[lang, source].update(terms(r.text))
        held[lang].update(set(terms(r.text)))
    for lang, source in said:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for x, s in said if x == lang]
        n = {s: sum(said[lang, s][t] for t in kept) for s in sources}
        p = lambda c, total: 1 + 1_000_000_000 * (c + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(-sum(f(p(said[lang, source][t], n[source]), p(said[lang, s][t], n[s])) for t in kept), s.encode()) for s in sources if s != source]
        best = []
        for t in kept:
            own, all_ = p(said[lang, source][t], n[source]), p(sum(said[lang, s][t] for s in sources), sum(n.values()))
            if said[lang, source][t] and own > all_:
                best.append((-f(own, all_), t.encode()))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:shown])):
            for k, (v, item) in enumerate(found):
                out[lang, source, part, item.decode(), -v, k + 1] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_source_audit(spark, monkeypatch, small):
    if small:  # many flushes, ranges, rows and sums that are handed out one by one
        for name, value in {"LEAVES": 5, "RANGE": 7, "ROW": 2, "HEAD": 2, "SQUARE": 1, "LOOKUP": 0, "SLICE": 90, "DEPTH": 1}.items():
            monkeypatch.setattr(source_audit, name, value)
    docs = documents(spark)
    got = collections.Counter(map(tuple, source_audit.audit(docs).collect()))
    assert got == audited(docs.collect())
    assert any(k[2] == "term" for k in got)
    assert source_audit.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_source_audit_without_kept_terms_and_with_ties(spark):
    few = documents(spark, ["a b", "c", None], langs=("en",))
    rows = source_audit.audit(few).collect()
    assert {(r.part, r.value) for r in rows} == {("pair", 0)}
    assert [r.item for r in sorted(rows, key=lambda r: r["rank"]) if r.source == "s2"] == ["", "s0"]  # ties by name
    tied = documents(spark, [f"{'common ' * 3}{' '.join(f'w{chr(97 + k)}' for k in range(26))}"] * 24 + ["other"] * 24, langs=("en",), sources=("a", "b"))
    assert collections.Counter(map(tuple, source_audit.audit(tied).collect())) == audited(tied.collect())


def trie_of(terms):
    size = np.array([len(t) for t in terms], np.int64)
    return source_audit.Trie(np.frombuffer(b"".join(terms), np.uint8), np.cumsum(size) - size, size)


@pytest.mark.parametrize("depth", [8, 1, 0])
def test_tries_are_in_order_of_bytes(monkeypatch, depth):
    monkeypatch.setattr(source_audit, "DEPTH", depth)
    rng = random.Random(3)
    terms = ["".join(rng.choices("abé漢", k=rng.choice([1, 2, 3, 4, 8, 9, 16, 17, 40, 200]))).encode() for _ in range(600)] + [b"a" * n for n in range(1, 90)]
    trie = trie_of(terms * 2)
    assert trie.terms() == sorted(set(terms)) and len(trie) == len(set(terms))
    assert [trie.terms()[i] for i in trie.leaf] == terms * 2
    assert len(trie_of([])) == 0 and trie_of([]).terms() == []


def test_tries_merge():
    rng = random.Random(3)
    parts, want = [], collections.defaultdict(lambda: [0, collections.Counter()])
    for p in range(3):
        terms = sorted({"".join(rng.choices("abé", k=rng.randint(1, 6))).encode() for _ in range(60)})
        docs = np.array([rng.randint(1, 9) for _ in terms])
        entries = sorted((i, s) for i in range(len(terms)) for s in range(4) if rng.random() < 0.5)
        count = np.array([rng.randint(1, 99) for _ in entries])
        parts.append(source_audit.Counted(terms, docs, np.array([i for i, _ in entries]), np.array([s for _, s in entries]), count))
        for t, d in zip(terms, docs, strict=True):
            want[t][0] += d
        for (i, s), c in zip(entries, count, strict=True):
            want[terms[i]][1][s] += c
    whole = source_audit.merged(parts, 4)
    assert whole.terms == sorted(want) and whole.docs.tolist() == [want[t][0] for t in whole.terms]
    got = collections.defaultdict(collections.Counter)
    for t, s, c in zip(whole.term, whole.source, whole.count, strict=True):
        got[whole.terms[t]][int(s)] += int(c)
    assert got == {t: c for t, (_, c) in want.items() if c}


def test_probabilities_are_exact():
    counts, totals = np.array([[0, 5, 10**14]]), np.array([0, 5, 10**15])
    got = source_audit.smoothed(counts, totals, 7)
    assert got.tolist() == [[1 + 10**9 * (int(c) + 2) // (int(t) + 14) for c, t in zip(counts[0], totals, strict=True)]]
