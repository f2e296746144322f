"""Lattices of many words at once: each step works on the values of one place in all words, which lie together."""

from __future__ import annotations

import numpy as np
import pytest

from palisand.llm import lattice_lm


def test_places_are_rows_and_totals_are_sums_over_all_segmentations():
    v = lattice_lm.vocabulary({"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "▁ab": 5, "ba": 6})
    words = ["ab", "ba", "bb", "aé"]
    x = lattice_lm.Lattice(words, v, v.start)
    assert x.forward.shape == (4, len(words)) and x.forward.flags.c_contiguous
    piece = {p: i for i, p in enumerate(["▁", "a", "b", "▁a", "ab", "▁ab", "ba"])}

    def paths(rest: str, first: int) -> float:
        if not rest:
            return 10 ** v.start[1, -1]
        found = sum(10 ** v.start[first, i] * paths(rest[len(p) :], 1) for p, i in piece.items() if rest.startswith(p))
        if rest[0] not in piece:
            found += float(np.prod([10 ** v.start[1, v.byte[b]] for b in rest[0].encode()])) * paths(rest[1:], 1)
        return found

    assert x.total() == pytest.approx([np.log10(paths("▁" + w, 0)) for w in words])
