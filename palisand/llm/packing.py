"""Best-fit packing by sums of squares.

Documents become token ids and an end id; those of more than CAPACITY ids are cut into
pieces of CAPACITY, the rest of the division first.  Pieces are dealt evenly to
groups of at most about GROUP pieces, each packed in one task.  Within a group, longer pieces first, a piece goes
into the open sequence with room for it where the sum over all gaps g of (open sequences with gap g)
squared becomes smallest, of equal ones into the fullest; only where no sequence has room is a new one opened.
A group has about one sequence more than its ids need, so packing in groups costs one in some 20,000.

Cases: null text is empty (a single end id); a piece of full length has a sequence of
its own; repeated rows are packed each; null doc_id is a value like any other; very long texts: memory of a few times the text;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.llm.shared import only
from palisand.llm.token_ids import encoder, texts

CAPACITY = 1024
#: Pieces that one task packs.
GROUP = 50_000


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only("token ids")
        encode = encoder(path).ids
        for doc_ids, bodies in texts(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(doc_ids, bodies, strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                start = 0
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    for column, x in zip(rows, (doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]), strict=True):
                        column.append(x)
                    start = stop
            kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length (in this order): its sequence's number and its place there; then the gap of each sequence."""
    n_open = np.zeros(capacity + 1, dtype=np.int64)  # by gap; full sequences (gap 0) don't count
    stacks: defaultdict[int, list[int]] = defaultdict(list)
    sequence, place, gaps = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), []
    for i, s in enumerate(lengths.tolist()):
        # from gap g to g - s the sum of squares changes by 2 * (n[g - s] - n[g] + 1), and by 1 - 2 * n[g] if that fills the sequence
        room = n_open[s:capacity]
        change = 2 * (n_open[: capacity - s] - room + 1)
        change[:1] -= 1
        change[room == 0] = np.iinfo(np.int64).max
        left = int(change.argmin()) if room.any() else capacity - s  # of equal ones the fullest sequence
        gap = left + s
        if gap == capacity:
            at = len(gaps)
            gaps.append(capacity)
        else:
            at = stacks[gap].pop()
            n_open[gap] -= 1
        sequence[i], place[i] = at, capacity - gap
        gaps[at] = left
        if left:
            stacks[left].append(at)
            n_open[left] += 1
    return sequence, place, np.array(gaps, dtype=np.int64)


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """df, a table of pieces that can be read again at will (with doc_id, piece, start, length and any more), with sequence_id and offset."""
    import pyarrow as pa
    from pyspark.sql import types as T

    part, full = df.filter(F.col("length") < capacity), df.filter(F.col("length") >= capacity)
    groups = max(1, -(-part.count() // GROUP))
    order = [("length", "descending"), *((c, "ascending") for c in df.columns if c != "length")]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        sequence, place, _ = sum_of_squares(rows["length"].to_numpy(), capacity)
        group = rows["group"][0].as_py()
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array((np.int64(group) << 32) + sequence)).append_column("offset", pa.array(place))

    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = part.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups))).repartition(groups, "group")
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return dealt.groupBy("group").applyInArrow(run, schema).unionByName(alone)
