"""The operators against brute force, on edge cases and on small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palisand.llm import bpe_codec, fm_classifier, jaccard_join, lattice_lm, line_dedup, packing, quality_rules, queries, token_store, topk_search, url_filter
from palisand.llm.shared import new_folder, staged
from palisand.llm.token_ids import encoder

DATA = "/root/testdata/sf0.001"
JSON, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row string, n string, word string"

PROSE = [" ".join(random.Random(i).choices("the quick brown fox jumps over a lazy dog while seven wise owls watch from old trees".split(), k=80)) for i in range(12)]
TEXTS = [
    None, "", " \n\t", "one", "one two three four", "One TWO three four", "a  b\n c\u00a0d \u2028 e's don't<|endoftext|>x", "\u00c9t\u00e9 \u00c9T\u00c9 \U0001f600 \x1c\x1d", "x" * 5000,
    "same line\nother\nsame line\n  SAME line \n", *PROSE, *PROSE[:4], PROSE[0] + " and one more", PROSE[1].upper(), "\n".join(["shared footer", PROSE[2]]), " ".join(PROSE * 20),
]


def documents(spark, texts=TEXTS, langs=("en", None, "fr")):
    rows = [(i if i != 3 else None, t, langs[i % 3], f"s{i % 2}" if i % 5 else None, None if t is None else len(t), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += rows[10:12]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def found(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in ours.collect()))) == sorted(map(repr, theirs.select(*columns).fetchall()))


def repeat_words(words):
    where = collections.defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    return len({j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 3)})


def test_quality_rules(spark):
    got = found(quality_rules.judge(documents(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = collections.Counter()
    for r in documents(spark).collect():
        w, t = words_of(r.text), r.text or ""
        lines = [x for x in t.split("\n") if words_of(x)]
        n = repeat_words(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))] += 1
    assert got == want
    assert quality_rules.judge(empty(spark)).count() == 0
    assert quality_rules.filtered(documents(spark)).columns == documents(spark).columns


def test_quality_rules_drop_outliers_only(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(rng.randint(60, 200))) for _ in range(600)]
    junk = ["*** ".join(t.split()) for t in texts[:10]]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, texts + junk, ("en",) * 3)).collect()}
    assert not any(kept[i] for i in range(600, 610)) and sum(kept[i] for i in kept if i is not None and i < 600) >= 597


def test_quality_rules_bear_measures_that_are_mostly_zero(spark):
    """One mark in a hundred texts is not too many, though all quantiles are 0; very many are."""
    rng = random.Random(4)
    plain = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(rng.randint(60, 200))) for _ in range(400)]
    marked = [t.replace(" ", f"{m} ", k) for t, m, k in zip(plain, "!%A!%", (1, 1, 1, 2, 2))]
    junk = [t.replace(" ", f"{m} ", 40) for t, m in zip(plain, "!%")]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, ["x"] * 4 + plain + marked + junk, ("en",) * 3)).collect()}
    assert all(kept[i] for i in range(404, 409)) and not kept[409] and not kept[410]


def test_topk_ties_across_shards_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 7)
    monkeypatch.setattr(topk_search, "TILE", 3)
    monkeypatch.setattr(topk_search, "FAN_IN", 2)
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)]
    table = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), 1)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.topk(table, table.filter("vec_id % 10 = 0"), 5).collect()}
    want = {}
    for q in range(0, 60, 10):
        best = sorted((-(q % 3) * (i % 3) - 1, i) for i in range(60) if i != q)[:5]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want


def test_ids_that_are_strings(spark):
    docs = documents(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    n = docs.count()
    assert packing.pack(staged(packing.pieces(docs, JSON, 2).drop("ids"), "t")).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert bpe_codec.decode(bpe_codec.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).count() == n
    folder = new_folder(spark, "test")
    token_store.write(docs, JSON, folder, 0)
    rows = token_store.checksums(spark, folder).orderBy("start").collect()
    assert len(rows) == n and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or ""))
    machine = fm_classifier.train(docs, docs.select("doc_id", F.lit(1).alias("label")))
    assert fm_classifier.score(docs, machine).count() == n
    assert jaccard_join.join(docs).count() == n and line_dedup.dedup(docs).count() == n


def test_repeated_ids_teach_the_same_machine(spark):
    rows = [(i // 2, f"{t} {i}") for i, t in enumerate(PROSE * 2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    one, two = (fm_classifier.train(spark.createDataFrame(x, "doc_id long, text string").repartition(k), labels) for x, k in ((rows, 1), (rows[::-1], 3)))
    assert np.array_equal(one.linear, two.linear) and np.array_equal(one.factors, two.factors)


def test_quality_fences_follow_their_source(spark):
    def fences(means):
        rng = random.Random(2)
        rows = [(i, " ".join("a" * max(1, round(rng.gauss(m, 1))) for _ in range(80)), "en", s) for s, m in means.items() for i in range(300)]
        measures = quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).withColumn("base_failed", F.lit(False))
        return {r.source.source: r.fences["word_len"] for r in quality_rules.thresholds(quality_rules.sketches(measures)).collect()}

    one, two = fences({"a": 5, "b": 9}), fences({"a": 5, "b": 12})
    assert one["a"].lo < 5000 < one["a"].hi < 9000 - 1000 < one["b"].lo + 1000 < 9000 < one["b"].hi  # each source has its own
    assert two["b"].hi > one["b"].hi + 1000  # and it moves with the source


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = [list(map(float, x)) for x in rng.normal(size=(300, 5)).round(1)]
    v[7], v[8], v[9], v[20] = None, [float("nan")] * 5, [1.0, None, 2.0, 3.0, 4.0], [0.5] * 3
    rows = [(i, x, "clash") for i, x in enumerate(v)] + [(None, v[0], "x"), (11, v[11], "x")]
    table = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), 256)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.topk(table, table.filter("vec_id % 10 = 0"), 5).collect()}
    ok = [(i, [math.floor(256 * e) for e in x]) for i, x, _ in rows if i is not None and x and all(e is not None and math.isfinite(e) for e in x)]
    want = {}
    for q, x in dict((i, x) for i, x in ok if i % 10 == 0).items():
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(x) == len(y))[:5]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want
    assert topk_search.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**22, -3.0]])).tolist() == [[2**62 - 3]]
    none = table.filter("vec_id < 0")
    assert topk_search.topk(none, none, 5).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://xexample.org/en/1", "http://example.org", "ftp://u@b.fr.com:80/fr/?q", "http://com/de/#f", "http://x.com?/de/", "http://a/b://org/", "http://org./es/", "http://.org/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(4, urls[4], "x", "y")], "page_id long, url string, host string, rule string")
    got = found(url_filter.judge(pages, url_filter.rule_table(spark, queries.URL_RULES)), "page_id", "host", "path", "rule", "verdict")
    want = collections.Counter()
    for r in pages.collect():
        rest = (r.url or "").split("://", 1)[1] if "://" in (r.url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = lowered(host)
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want[(r.page_id, host, path, best and best[3], best[2] if best else "allow")] += 1
    assert got == want
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, queries.URL_RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark, queries.URL_RULES).limit(0)).collect()} == {"allow"}


def check_packing(rows, docs, capacity):
    """rows: pieces; docs: (doc_id, ids with the end) in any number."""
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = collections.Counter()
    for doc_id, ids in docs:
        start, n, piece = 0, len(ids) % capacity or min(capacity, len(ids)), 0
        while start < len(ids):
            want[(doc_id, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
            start, n, piece = start + n, capacity, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(sequences)


def whole_ids(text, end):
    return [*encoder(JSON).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_packing(spark):
    cut = packing.pieces(documents(spark), JSON, 2, 64).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    n = check_packing(packing.pack(staged(cut, "t"), 64).collect(), [(r.doc_id, whole_ids(r.text, 2)) for r in documents(spark).collect()], 64)
    assert n <= 1.05 * sum(len(whole_ids(r.text, 2)) for r in documents(spark).collect()) / 64 + 2
    assert packing.pack(staged(packing.pieces(empty(spark), JSON, 2).drop("ids"), "t")).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_sum_of_squares_is_the_least_change(descending):
    rng, capacity = random.Random(5), 20
    lengths = np.array(sorted((rng.randint(1, 19) for _ in range(300)), reverse=True) if descending else [rng.randint(1, 19) for _ in range(300)])
    sequence, place, gaps = packing.sum_of_squares(lengths, capacity)
    room: dict[int, int] = {}
    for s, at, x in zip(lengths.tolist(), sequence.tolist(), place.tolist(), strict=True):
        count = collections.Counter(g for g in room.values() if g)
        square = lambda gap: sum(v * v for v in (count - collections.Counter([gap]) + collections.Counter([gap - s] if gap > s else [])).values())  # noqa: B023, E731
        options = {g: square(g) for g in count if g >= s} or {capacity: 0}
        assert options[room.get(at, capacity)] == min(options.values()) and x == capacity - room.get(at, capacity)
        room[at] = room.get(at, capacity) - s
    assert [room[i] for i in range(len(gaps))] == gaps.tolist()


def test_packing_is_tight():
    rng = np.random.default_rng(4)
    lengths = np.sort(np.clip(rng.exponential(300, 5000), 1, 1023).astype(int))[::-1]
    _, _, gaps = packing.sum_of_squares(lengths)
    assert len(gaps) <= -(-lengths.sum() // 1024) + 2


def test_line_dedup(spark):
    texts = [*TEXTS, *(f"Footer \t\n{i}\n\nBody {i}\n  fOOTER\r" for i in range(12))]
    docs = documents(spark, texts)
    key = lambda x: lowered(x.strip(" \t\n\x0b\x0c\r"))
    count = collections.Counter(k for r in docs.collect() for k in {key(x) for x in (r.text or "").split("\n")})
    want = collections.Counter()
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < 10]
        want[(r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert found(line_dedup.dedup(docs), "doc_id", "n_lines", "n_dropped", "text") == want
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_lattice(spark):
    docs = documents(spark)
    got = lattice_lm.score(docs, fm_classifier.remainder(7) == 2, PIECES).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(r.doc_id, [*lowered(r.text).encode().split(), b""]) for r in docs.collect()]
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # each document's score from an independent recursion over pieces
    counts = staged(lattice_lm.word_counts(docs, ~F.coalesce(fm_classifier.remainder(7) == 2, F.lit(False))), "t")
    v = lattice_lm.read_vocabulary(PIECES)
    e, found_whole = lattice_lm.estimated(counts.filter("c > 0"), v)
    logs, whole = e.logs, {bytes(r.word): r.whole for r in found_whole.collect()}
    assert all(x == 0 or c[w] >= lattice_lm.WHOLE and x <= c[w] for w, x in whole.items()) and any(whole.values())
    assert abs(sum(10.0 ** logs[0]) + sum(whole.values()) / 10**e.total - 1) < 1e-6 and abs(sum(10.0 ** logs[1]) - 1) < 1e-9  # what begins a token, and what goes on
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    piece = {sp.id_to_piece(i): logs[:, k] for k, i in enumerate(plain)}

    def recursion(word):
        if not word:
            return logs[0, -1]
        text = "▁" + word.decode()
        reached = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            steps = [reached[a] + piece[text[a:end]][min(a, 1)] for a in range(max(0, end - 16), end) if text[a:end] in piece]
            if text[end - 1] not in piece:
                steps.append(reached[end - 1] + sum(logs[1, len(plain) + b] for b in text[end - 1].encode()))
            top = max(steps)
            reached[end] = top + math.log10(sum(10 ** (x - top) for x in steps))
        return reached[-1] + logs[1, -1]

    p = {w: math.log10(10 ** recursion(w) + whole.get(w, 0.0) / 10**e.total) if recursion(w) > -290 else recursion(w) for _, ws in tokens for w in ws}
    key = lambda r: (r[0] is not None, r)
    for a, b in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(((i, sum(p[w] for w in ws)) for i, ws in tokens), key=key), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-6, abs_tol=1e-4)
    assert lattice_lm.score(empty(spark), F.lit(False), PIECES).count() == 0


def test_lattice_sums_all_segmentations():
    weights = {"▁": 0.1, "▁a": 0.13, "a": 0.08, "b": 0.05, "ab": 0.2, "▁ab": 0.02, "bc": 0.01}
    v = lattice_lm.vocabulary(dict.fromkeys(weights, 0.0), weights=np.array([*weights.values(), *[0.001] * 256, 0.1]))
    names = list(weights)
    chance = 10**v.start
    assert np.allclose(chance.sum(axis=1), 1)

    def segmentations(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in weights:
                yield from ([names.index(text[:k]), *rest] for rest in segmentations(text[k:]))
        if text and text[0] not in weights:
            yield from ([*(v.byte[x] for x in text[0].encode()), *rest] for rest in segmentations(text[1:]))

    words = ["a", "ab", "abab", "abcab", "é", "aéb", "ba", "c"]
    seen = set()
    for at, lattice in lattice_lm.lattices(words, v, v.start):
        count = np.zeros((2, v.n + 1))
        for i, total in zip(at, lattice.total(), strict=True):
            seen.add(i)
            ways = [(math.prod(chance[min(j, 1), x] for j, x in enumerate(way)) * chance[1, -1], way) for way in segmentations("▁" + words[i])]
            assert math.isclose(total, math.log10(sum(x for x, _ in ways)), rel_tol=1e-12)
            for x, way in ways:
                np.add.at(count, (np.minimum(np.arange(len(way)), 1), way), x / sum(y for y, _ in ways))
                count[1, -1] += x / sum(y for y, _ in ways)
        assert np.allclose(lattice.expected(np.ones(len(at))), count)
        assert np.allclose(lattice.expected(np.full(len(at), 2.5)), 2.5 * count)
    assert seen == set(range(len(words)))


def test_pieces_never_get_less_likely(spark):
    rows = [(bytearray(w.encode()), 1 + len(w) % 4) for w in sorted({x for t in PROSE[:2] for x in {*t.split(), t[:30].replace(" ", "é"), ""}})]
    words = spark.createDataFrame(rows, "word binary, c long")
    trace = lattice_lm.estimated(words, lattice_lm.read_vocabulary(PIECES), 6, 0.0)[0].trace
    assert len(trace) == 6 and all(b >= a - 1e-4 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] > trace[0] + 10
    assert len(lattice_lm.estimated(words, lattice_lm.read_vocabulary(PIECES), gain=0.5)[0].trace) == 2  # the stopping rule


def test_token_store(spark, monkeypatch):
    docs, folder = documents(spark), new_folder(spark, "test")
    token_store.write(docs, JSON, folder, 0)
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = whole_ids(r.text, 0)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found(token_store.checksums(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == collections.Counter(want)
    assert {(r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in token_store.read_ids(spark, folder).collect()} == {(a, b, d) for a, b, _, d in want}
    monkeypatch.setattr(token_store, "HOT", 1)  # every repeated chunk is joined apart
    assert found(token_store.checksums(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == collections.Counter(want)
    stored = spark.read.parquet(f"{folder}/data").filter("kind = 'chunk'")
    assert stored.count() == stored.select("key").distinct().count()
    path = f"{folder}/manifest"
    spark.read.parquet(path).withColumn("root", F.lit("0")).write.parquet(f"{folder}/bad")
    os.rename(path.removeprefix("file://"), f"{path}-old".removeprefix("file://"))
    os.rename(f"{folder}/bad".removeprefix("file://"), path.removeprefix("file://"))
    with pytest.raises(ValueError):
        token_store.checksums(spark, folder)
    none = new_folder(spark, "test")
    token_store.write(empty(spark), JSON, none, 0)
    assert token_store.checksums(spark, none).count() == 0


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype("<u4")

    def names(x):
        ends, _ = token_store.cut_points(x, [len(x)])
        return {token_store.name_of(x[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)}

    assert len(names(ids) & names(np.concatenate([ids[:5000], ids[5001:]]))) > 0.9 * len(names(ids))
    # streams cut together are cut as each by itself
    stops = [1, 1, 70, 5000, 5003, 20000]
    ends, counts = token_store.cut_points(ids, stops)
    assert sum(counts) == len(ends) and ends[-1] == 20000
    want = []
    for a, b in zip([0, *stops], stops, strict=False):
        want += [a + e for e in token_store.cut_points(ids[a:b], [b - a])[0]]
    assert ends == want


def test_classifier(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op8_quality_classifier(spark, DATA).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in queries.op8_quality_classifier(spark, big).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95
    machine = fm_classifier.train(documents(spark), documents(spark).selectExpr("doc_id", "cast(doc_id % 2 as int) as label"))
    assert fm_classifier.score(documents(spark), machine, keep=["text"]).count() == documents(spark).count()
    assert fm_classifier.score(empty(spark), fm_classifier.train(empty(spark), spark.createDataFrame([], "doc_id long, label int"))).count() == 0


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(2)
    m = fm_classifier.Machine(0.1, rng.normal(size=fm_classifier.BUCKETS + fm_classifier.STATS), rng.normal(size=(fm_classifier.BUCKETS + fm_classifier.STATS, 4)))
    index, value, stats = fm_classifier.features("some words in A text, some more\n!!")
    at = np.concatenate([index, np.arange(fm_classifier.STATS) + fm_classifier.BUCKETS])
    x = np.concatenate([value, stats])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    assert np.isclose(fm_classifier._logits(m, [(index, value, stats)])[0], 0.1 + m.linear[at] @ x + pairs)


def brute_components(rows):
    sets = []
    for doc_id, text in rows:
        w = lowered(text).encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                part[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return collections.Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(n, seed):
    rng, out = random.Random(seed), []
    for g in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 8, 12, 20, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 99)}"
            out.append(" ".join(w + ["tail"] * rng.randint(0, 1)))
    return out


@pytest.mark.parametrize("long, split", [(32, 50_000), (2, 50_000), (2, 4)])
def test_jaccard(spark, monkeypatch, long, split):
    monkeypatch.setattr(jaccard_join, "LONG", long)  # 2: nearly all goes through the long lists
    monkeypatch.setattr(jaccard_join, "SPLIT", split)  # 4: many lists are dealt to several tasks
    monkeypatch.setattr(jaccard_join, "HUBS", 1)
    monkeypatch.setattr(jaccard_join, "MANY", 0 if split == 4 else 2)  # 0: all tiles are crowded
    monkeypatch.setattr(jaccard_join, "TILE", 2048 if long > 2 else 4)
    monkeypatch.setattr(jaccard_join, "LOCAL_FROM", 2)
    monkeypatch.setattr(jaccard_join, "HEAVY_FROM", 2)
    docs = documents(spark, [*TEXTS, *near_copies(40, 7)])
    got = jaccard_join.join(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)
    left = jaccard_join.deduplicated(docs)
    assert left.columns == docs.columns
    wordless = sum(1 for _, t in rows if not words_of(t))
    assert left.count() == got.filter("n_shingles > 0").select("component").distinct().count() + wordless
    assert jaccard_join.join(empty(spark)).count() == 0


def test_fine_signatures_bound_the_overlap():
    rng = np.random.default_rng(6)
    for n, m in ((1, 5), (70, 70), (300, 250), (2000, 1700), (5000, 400)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        s, t = np.unique(pool[:n]), np.unique(np.r_[pool[: n // 2], pool[n : n + m - min(m, n // 2)]])
        both = len(np.intersect1d(s, t))
        assert both <= jaccard_join.fine_bound(jaccard_join.fine(s), jaccard_join.fine(t)) <= min(len(s), len(t)) or len(s) < 64


def test_jaccard_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert found(queries.op9_jaccard_join(spark, DATA), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_bpe(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark)
    model = RANKS, public_tokenizers.PATTERN
    got = found(bpe_codec.decode(bpe_codec.encode(docs, *model), RANKS).select("doc_id", F.col("ids").cast("string").alias("ids"), F.sha2("data", 256).alias("h")), "doc_id", "ids", "h")
    want = collections.Counter((r.doc_id, str(theirs.encode_ordinary(r.text or "")).replace(" ", "").replace(",", ", "), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert got == want
    assert bpe_codec.decode(bpe_codec.encode(empty(spark), *model), RANKS).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_encoders_agree_on_odd_texts(seed):
    import tiktoken

    rng = random.Random(seed)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, codec = encoder(JSON), bpe_codec.codec(RANKS, public_tokenizers.PATTERN)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1c", "\x85", "a", "Zed", "\u00e9", "1", "22", "'s", "'", "don't", "\u4e2d", "\U0001f600", ".", "!?", "_", "\u0301", "\u00b2", "\u2165"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        plain = theirs.encode_ordinary(text)
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == plain == ours.tokenizer.encode(text, add_special_tokens=False).ids
        codec.learn([text])
        assert codec.encode(text).tolist() == plain


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as pipeline

    good = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    odd = documents(spark).select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("score"), F.lit("y").alias("doc"), F.lit(1).alias("k1"), "row", F.lit(None).cast("string").alias("drop"))
    docs = odd.unionByName(good.withColumns({"score": F.lit("x"), "doc": F.lit("y"), "k1": F.lit(1), "row": F.lit("clash"), "drop": F.lit(None).cast("string")}))
    docs = staged(docs.unionByName(docs.limit(5)), "t")
    for some in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            # each stage alone, on all odd rows
            got = stage(spark, some, DATA)
            assert got.columns == docs.columns and got.count() <= some.count()
        assert pipeline.STAGES[-1][1](spark, some, DATA).select("doc_id").distinct().count() == some.select("doc_id").distinct().count()


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, staged(stage(spark, docs, DATA), "test")
        if i < 4:
            assert docs.columns == before.columns
    first = spark.read.parquet(f"{DATA}/documents.parquet")
    good = staged(pipeline.STAGES[0][1](spark, first, DATA), "t")
    kept = staged(pipeline.STAGES[1][1](spark, good, DATA), "t")
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(good).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}
    thin = staged(pipeline.STAGES[2][1](spark, kept, DATA), "t")
    assert thin.count() == kept.count()
    single = pipeline.STAGES[3][1](spark, thin, DATA).collect()
    groups = brute_components([(r.doc_id, r.text) for r in thin.collect()])
    assert {r.doc_id for r in single} == {d for d, _, c in groups if d == c}
    check_packing(docs.collect(), [(r.doc_id, whole_ids(r.text, 2)) for r in single], 1024)
