"""Single linkage of many assets: the least spanning tree of their distances, in rounds.

In each round every component finds its least edge to another one, an aggregate over the table of pairs; at least half of the components
vanish.  Distances are ordered together with names, so that no two edges are equal and the tree is the same however the pairs lie.  What reaches the driver are
the edges found, one for each component, and at the end the tree, one edge less than there are assets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.storage import staged


class Parts(dict):
    """Which component a name is in."""

    def of(self, x: str) -> str:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x

    def join(self, x: str, y: str) -> bool:
        x, y = sorted((self.of(x), self.of(y)))
        self[y] = x
        return x != y


def distances(correlations: DataFrame) -> DataFrame:
    """i, j, d = sqrt((1 - rho) / 2) of i, j, rho."""
    return correlations.select("i", "j", F.sqrt(F.greatest((1 - F.col("rho")) / 2, F.lit(0.0))).alias("d"))


def spanning(pairs: DataFrame) -> list[tuple[float, str, str]]:
    """The edges (d, i, j) of the least spanning tree of pairs (i < j, d), in ascending order; of equal distances the first names."""
    pairs, parts, found = staged(pairs, "distances"), Parts(), []
    while True:
        known = [(x, parts.of(x)) for x in list(parts)]
        least = F.min(F.struct("d", "i", "j")).alias("e")
        if known:
            names = F.broadcast(pairs.sparkSession.createDataFrame(known, "name string, part string"))  # a row for each asset
            side = lambda c: names.select(F.col("name").alias(c), F.col("part").alias(f"part_{c}"))  # noqa: E731, B023
            apart = pairs.join(side("i"), "i", "left").join(side("j"), "j", "left").filter("part_i <> part_j")
        else:
            apart = pairs.withColumns({"part_i": F.col("i"), "part_j": F.col("j")})
        ends = apart.select(F.explode(F.array("part_i", "part_j")).alias("part"), "d", "i", "j")
        new = sorted({tuple(r.e) for r in ends.groupBy("part").agg(least).collect()})
        if not new:
            return sorted(found)
        found += [e for e in new if parts.join(e[1], e[2])]


@dataclass(frozen=True)
class Linkage:
    """Merges (cluster, cluster, distance), clusters being numbered from the assets' places and on; and the assets."""

    assets: list[str]
    merges: list[tuple[int, int, float]]

    def order(self) -> list[int]:
        """Places of assets in the order of the tree."""
        held = {i: [i] for i in range(len(self.assets))}
        for k, (i, j, _) in enumerate(self.merges):
            held[len(self.assets) + k] = held.pop(i) + held.pop(j)
        return [x for part in held.values() for x in part]

    def clusters(self, most: int) -> list[int]:
        """Cluster of each asset, numbered from 1 by its first one, when the tree is cut into at most this many."""
        n = len(self.assets)
        held = {i: [i] for i in range(n)}
        for k, (i, j, _) in enumerate(self.merges[: max(n - most, 0)]):
            held[n + k] = held.pop(i) + held.pop(j)
        out = [0] * n
        for k, members in enumerate(sorted(held.values(), key=min)):
            for x in members:
                out[x] = k + 1
        return out


def linkage(assets: list[str], edges: list[tuple[float, str, str]]) -> Linkage:
    """Single linkage of assets (in order) from their spanning tree."""
    parts, number, merges = Parts(), {a: i for i, a in enumerate(assets)}, []
    for d, x, y in edges:
        i, j = sorted((number[parts.of(x)], number[parts.of(y)]))
        parts.join(x, y)
        merges.append((i, j, d))
        number[parts.of(x)] = len(assets) + len(merges) - 1
    return Linkage(assets, merges)
