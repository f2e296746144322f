"""The fixed labels: each name stands for one thing."""

from __future__ import annotations

import ast
from collections import Counter

from pyspark.sql import functions as F

from palisand.functions import scalars


def test_no_fixed_value_is_named_twice():
    tree = ast.parse(open(scalars.__file__).read())
    names = Counter(t.id for node in tree.body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name))
    assert [name for name, n in names.items() if n > 1] == []


def test_heavy_tails_are_labelled(spark):
    rows = spark.range(-1, 4).select(F.col("id"), scalars.label(F.col("id").cast("double"), scalars.KURTOSIS, strict=True).alias("tails")).collect()
    assert {r.id: r.tails for r in rows} == {-1: "normal", 0: "normal", 1: "normal", 2: "fat", 3: "fat"}
