"""Pieces that several operators use."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisand.storage import LOOKUP, finished, looked_up, new_folder, released, removed, shuffles_freed, staged  # noqa: F401  for the modules of this package

#: ASCII white space, the only characters that part words and are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[ \x09-\x0D]+"), "")


def row_key(*columns: str) -> list[Column]:
    """Two long columns that identify a row's content (128 hash bits, never null).
    Rows that are equal in these columns share a key."""
    return [
        F.xxhash64(*columns).alias("k1"),
        F.xxhash64(F.lit(7), *reversed(columns)).alias("k2"),
    ]


def sliced(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices of so many rows, so that what a task makes of them stays small; memory that a batch took is given back after it."""
    import pyarrow as pa

    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()
        _given_back()


#: What operators remember in a Python worker, which lives on after a task: name -> how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[name] = forget


def only(name: str) -> None:
    """What others than this one remember in this worker goes: a task needs its own words alone."""
    for other, forget in _REMEMBERED.items():
        if other != name:
            forget()
    _given_back()


def _given_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def one_thread() -> None:
    """Executors have their cores from Spark; libraries shall not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["OMP_NUM_THREADS"] = "1"
