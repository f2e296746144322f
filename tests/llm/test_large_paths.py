"""The ways that only large tables take, forced on small ones: the rows must be the same."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisand import storage
from palisand.llm import components as components_module
from palisand.llm import jaccard_join, line_dedup, packing, quality_rules
from palisand.llm.shared import staged


def texts(spark, n=240):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 120))) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = base[i % len(base)].split()
        if i % 3:
            w[rng.randrange(len(w))] = "other"
        rows.append((i, " ".join(w) + ("\nshared line" if i % 2 else ""), "en", f"s{i % 4}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)


def linked(spark, docs):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}


def brute(docs):
    sets = {r.doc_id: set(zip(*[r.text.lower().split()[k:] for k in range(5)], strict=False)) for r in docs.collect()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("settings", [
    {},
    {"TILE": 3, "LONG": 1, "BEST": 1, "MANY": 0},
    {"TILE": 2, "SPLIT": 5, "HUBS": 1, "HOT": 0, "AT_ONCE": 400, "STEP": 1.5},
    {"HEAVY": 3, "HEAVY_FROM": 2, "LOCAL_FROM": 1, "AT_ONCE": 50, "BUCKET": 10},
])
def test_jaccard_by_every_way(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    if settings.get("HOT") == 0:
        monkeypatch.setattr(storage, "LOOKUP", 0)
        monkeypatch.setattr(components_module, "LOOKUP", 0)
    docs = texts(spark)
    assert linked(spark, docs) == brute(docs)


def test_tiles_hold_all_that_can_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    rng = random.Random(2)
    sizes = [rng.randint(20, 90) for _ in range(60)]
    found = spark.createDataFrame([(7, k, n, k % 5) for k, n in enumerate(sizes)], "key long, sid long, n long, part long").withColumn("step", F.floor(F.ln("n") / float(np.log(jaccard_join.STEP))))
    by_step = {r.step: r for r in jaccard_join.tiles(found).collect()}
    rows = found.collect()
    for a in rows:
        for b in rows:
            if 5 * min(a.n, b.n) >= 4 * max(a.n, b.n):
                x, y = by_step[a.step], by_step[b.step]
                assert x.to0 <= y.tile0 and y.tile1 <= x.to1
    assert any(r.to1 - r.to0 < max(x.tile1 for x in by_step.values()) for r in by_step.values())  # some tiles don't meet
    assert jaccard_join.tiles(found.withColumn("part", F.lit(1))).count() == 0  # one component: nothing to do


@pytest.mark.parametrize("bound", [0, 1000])
def test_components_with_few_and_many_links(spark, monkeypatch, bound):
    monkeypatch.setattr(components_module, "LOOKUP", bound)
    monkeypatch.setattr(storage, "LOOKUP", bound)
    links = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {r.node: r.component for r in components_module.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i - i % 10 for i in range(40) if i % 10} | {k: 100 for k in range(101, 160)}


def test_packing_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 30)
    rng = random.Random(3)
    pieces = staged(spark.createDataFrame([(i, 0, 0, rng.choice([1024, rng.randint(1, 900)])) for i in range(200)], "doc_id long, piece int, start long, length long"), "pieces")
    rows = packing.pack(pieces).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 200
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    ids = sum(r.length for r in rows)
    assert len(held) <= -(-ids // 1024) + 7  # a sequence for each group, about


def test_lines_and_rules_by_lookups_that_are_not_sent(spark, monkeypatch):
    docs = texts(spark)
    one = lambda: (sorted(map(str, line_dedup.dedup(docs, 10).collect())), sorted(map(str, quality_rules.judge(docs).collect())))
    want = one()
    monkeypatch.setattr(line_dedup, "FEW", 0)
    monkeypatch.setattr(quality_rules, "GROUPS", 0)
    monkeypatch.setattr(storage, "LOOKUP", 0)
    assert one() == want


def test_lines_meet_their_documents_with_each_text_once(spark, monkeypatch):
    met, lookup = [], line_dedup.looked_up
    monkeypatch.setattr(line_dedup, "looked_up", lambda rows, *more, **named: met.append(rows) or lookup(rows, *more, **named))
    docs = texts(spark).withColumn("a.b", F.lit(1))
    assert line_dedup.cleaned(docs).columns == docs.columns and line_dedup.dedup(docs).count() == 240
    for rows in (x for x in met if "doc" in x.columns):
        assert "text" not in rows.schema["doc"].dataType.names
    assert line_dedup.FEW <= 10_000  # beyond that, what is sent to all tasks would grow with the documents
