"""Content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts every document's id stream into
chunks, so equal passages give equal chunks wherever they stand.  A chunk's
name is the 128-bit BLAKE2 digest of its ids; each distinct chunk is stored once.
A document is a recipe: its chunks' names and lengths.  The recipes lie in
ascending doc_id order with the number of ids before each.  A Merkle tree over the
recipes, one root per file group and one over all, is the manifest.  A reader
checks names against contents, recipes against roots, and lengths against both.

Folder (what is read back, ids included, comes from these files alone):
    data/kind=chunk     key (its name), payload (its ids, little-endian, of 2 or 4 bytes each), n_tokens; in buckets by key
    data/kind=recipe    as encoded; recipes has them in order
    recipes             part, doc_id, start, n_tokens, names, lengths (in order)
    manifest            part, n_docs, n_tokens, root; the row of part -1 is over all

Texts are encoded once, a batch of documents at a time: chunks and recipes leave the same pass (Spark has no other
way of two results of one pass), and chunks that a task has seen don't leave it again.
Reading joins the recipes' references with the bucketed chunks, which stay where they are, deals them to
documents, and puts every id stream together again.

Cases: null and empty texts are the end id alone; repeated rows and equal doc_ids
keep a recipe each, next to each other; null doc_id comes first, of any type; very long texts are whole;
an empty table gives an empty store and an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisand.llm.shared import looked_up, shuffles_freed, staged
from palisand.llm.token_ids import encoder

#: Ids that the rolling hash sees; a cut after one in EVERY positions; bounds of a chunk's length.
WINDOW, EVERY, LEAST, MOST = 4, 256, 64, 2048
#: Children of a Merkle node.
FAN_OUT = 1024
#: References from which a chunk is joined apart; such chunks that are broadcast (a few KB each).
HOT, SENT = 50_000, 5_000
#: Ids that are cut at a time, if a document isn't longer.
AT_ONCE = 500_000


@lru_cache(maxsize=1)
def _tables(n_ids: int) -> list[np.ndarray]:
    """For each place in the window, a fixed 64-bit number for each id."""
    x = (np.arange(n_ids, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return [x * np.uint64(0xBF58476D1CE4E5B9 ** (j + 1) % 2**64) for j in range(WINDOW)]


def cut_points(ids: np.ndarray, stops: Sequence[int]) -> tuple[list[int], list[int]]:
    """Ends of the chunks of id streams that follow one another and end at stops; how many chunks each stream has.
    A window that reaches into the stream before can't matter: no chunk is shorter than it."""
    tables = _tables(max(1 << 16, 1 << int(ids.max(initial=0)).bit_length()))
    h = tables[0][ids]
    for j in range(1, WINDOW):
        h[j:] += tables[j][ids[:-j]]
    marks = (np.flatnonzero((h >> np.uint64(40)) % np.uint64(EVERY) == 0) + 1).tolist()
    ends: list[int] = []
    counts, start, at = [], 0, 0
    for stop in stops:
        had, upto = len(ends), bisect_right(marks, stop, at)
        for m in [*marks[at:upto], stop]:
            while m - start > MOST:
                start += MOST
                ends.append(start)
            if m - start >= LEAST or m == stop and m > start:
                ends.append(m)
                start = m
        at = upto
        counts.append(len(ends) - had)
    return ends, counts


def name_of(ids) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def _binaries(data, ends: np.ndarray):
    """A binary Arrow array over one buffer, cut at ends."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype("<i4").tobytes()), pa.py_buffer(data)])


def _chunked(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of both kinds: chunks (key = name) and recipes (key = a number of the row)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    fields = [("kind", pa.string()), ("key", pa.binary()), ("doc_id", id_type), ("payload", pa.binary()), ("lengths", pa.binary()), ("n_tokens", pa.int64())]

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        encode, at, seen = encoder(path), 0, set()
        width = 2 if max(encode.n_ids, end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()

        def batch(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(columns), schema=pa.schema(fields))

        def cut(doc_ids: pa.Array, streams: list[bytes]) -> Iterator:
            nonlocal at
            sizes = np.array(list(map(len, streams))) // 4
            ids = np.frombuffer(b"".join(streams), dtype="<u4")
            ends, counts = cut_points(ids, np.cumsum(sizes).tolist())
            view = memoryview(ids).cast("B")
            names = [name_of(view[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)]  # noqa: B905
            lengths = np.diff(np.r_[0, ends])
            new = []
            for name in names:
                new.append(name not in seen)
                seen.add(name)
            if len(seen) > 500_000:
                seen.clear()
            mask, k = pa.array(new), sum(new)
            payload = _binaries(ids.astype(f"<u{width}").tobytes(), width * np.array(ends)).filter(mask)
            yield batch(pa.array(["chunk"] * k), pa.array([x for x, y in zip(names, new, strict=True) if y], type=pa.binary()), pa.nulls(k, id_type), payload, pa.nulls(k, pa.binary()), pa.array(lengths).filter(mask))
            upto, k = np.cumsum(counts), len(streams)
            keys = [part.to_bytes(8, "big") + x.to_bytes(8, "big") for x in range(at, at + k)]
            yield batch(pa.array(["recipe"] * k), pa.array(keys, type=pa.binary()), doc_ids, _binaries(b"".join(names), 16 * upto), _binaries(lengths.astype("<u4").tobytes(), 4 * upto), pa.array(sizes))
            at += k

        for b in batches:
            streams: list[bytes] = []
            size = first = 0
            for i, text in enumerate(b.column(1).to_pylist()):
                streams.append(encode.ids(text) + end)
                size += len(streams[-1]) // 4
                if size >= AT_ONCE:
                    yield from cut(b.column(0).slice(first, i + 1 - first), streams)
                    streams, size, first = [], 0, i + 1
            if streams:
                yield from cut(b.column(0).slice(first), streams)

    return docs.select("doc_id", "text").mapInArrow(run, f"kind string, key binary, doc_id {kind.simpleString()}, payload binary, lengths binary, n_tokens long")


def merkle(leaves: DataFrame) -> DataFrame:
    """part, root of leaves (part, at from 0, hash): nodes of FAN_OUT children, level upon level."""
    while True:
        leaves = leaves.groupBy("part", F.floor(F.col("at") / FAN_OUT).alias("at")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash")
        )
        if leaves.agg(F.max("at")).first()[0] in (None, 0):
            return leaves.select("part", F.col("hash").alias("root"))


def _leaves(recipes: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.hex("names"), F.hex("lengths"))
    return recipes.select("part", at.cast("long").alias("at"), F.sha2(text, 256).alias("hash"))


def _manifest(recipes: DataFrame) -> DataFrame:
    parts = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).join(merkle(_leaves(recipes)), "part")
    top = parts.agg(
        F.lit(-1).alias("part"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "root"))), lambda x: x["root"]), ""), 256).alias("root"),
    )
    return parts.unionByName(top)


def write(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    """Encode docs with the tokenizer file at path and write the store into a new folder."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = _chunked(docs, path, end_id).repartition(n, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("kind", "doc_id", "payload", "lengths", "n_tokens")])
    with shuffles_freed(spark):
        once.write.partitionBy("kind").bucketBy(n, "key").option("compression", "zstd").option("path", f"{folder}/data").saveAsTable(_table(folder))
    schema = f"key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, payload binary, lengths binary, n_tokens long, kind string"
    recipes = spark.read.schema(schema).parquet(f"{folder}/data").filter("kind = 'recipe'")
    ordered = recipes.repartitionByRange("doc_id", "payload", "key").select(
        F.spark_partition_id().alias("part"), "doc_id", "key", F.col("payload").alias("names"), "lengths", "n_tokens"
    )
    ordered.write.parquet(f"{folder}/ordered")  # the parts are fixed from here on
    ordered = spark.read.schema(ordered.schema).parquet(f"{folder}/ordered")
    before = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")  # a row for each part
    )
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "names", "key").rowsBetween(Window.unboundedPreceding, 0))
    placed = ordered.join(before, "part").withColumn("start", F.col("before") + running - F.col("n_tokens"))
    placed.select("part", "doc_id", "start", "n_tokens", "names", "lengths").sortWithinPartitions("part", "start").write.parquet(f"{folder}/recipes")
    _manifest(_recipes(spark, folder)).write.parquet(f"{folder}/manifest")


def _table(folder: str) -> str:
    """The catalog's name for the store's data: it knows their buckets."""
    return "palisand_" + hashlib.sha256(folder.encode()).hexdigest()[:32]


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/recipes")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """name, payload, stored (ids).  A session that has not written the store reads its files without their buckets."""
    if spark.catalog.tableExists(_table(folder)):
        data = spark.table(_table(folder))
    else:  # an empty store has no file that says its schema
        data = spark.read.schema("key binary, payload binary, n_tokens long, kind string").parquet(f"{folder}/data")
    return data.filter("kind = 'chunk'").select(F.col("key").alias("name"), "payload", F.col("n_tokens").alias("stored"))


def verify(spark: SparkSession, folder: str) -> None:
    """Raise ValueError unless the manifest is that of the recipes."""
    found, stored = _manifest(_recipes(spark, folder)), spark.read.parquet(f"{folder}/manifest")
    columns = found.columns
    if found.select(columns).exceptAll(stored.select(columns)).unionByName(stored.select(columns).exceptAll(found.select(columns))).limit(1).count():
        raise ValueError(f"the recipes of {folder} don't agree with its manifest")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    """start, at, name, n: a row per chunk of each recipe."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            names, lengths = (b.column(i).to_pylist() for i in (2, 3))
            counts = np.array(list(map(len, names)), dtype=np.int64) // 16
            n = np.frombuffer(b"".join(lengths), dtype="<u4").astype(np.int64)
            upto = np.cumsum(counts)
            sums = np.r_[0, np.cumsum(n)]
            if (counts * 4 != list(map(len, lengths))).any() or (sums[upto] - sums[upto - counts] != b.column(1).to_numpy()).any():
                raise ValueError("a recipe contradicts itself")
            at = np.arange(len(n)) - np.repeat(upto - counts, counts)
            columns = [pa.array(np.repeat(b.column(0).to_numpy(), counts)), pa.array(at), _binaries(b"".join(names), 16 * np.arange(1, len(n) + 1)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["start", "at", "name", "n"])

    return _recipes(spark, folder).select("start", "n_tokens", "names", "lengths").mapInArrow(run, "start long, at long, name binary, n long")


def _streams(spark: SparkSession, folder: str) -> DataFrame:
    """start, name, payload, n of every chunk of every document: a document's rows are together and in order."""
    references, chunks = staged(_references(spark, folder), "references"), _chunks(spark, folder)
    found = references.join(chunks, "name", "left")
    hot = staged(references.groupBy("name").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("name"), "hot-chunks")
    if not hot.isEmpty():  # no task gets all references to a chunk that very many documents have
        payloads = staged(looked_up(chunks, hot, "name", "left_semi"), "hot-payloads")
        start = F.col("start")
        found = looked_up(references, hot, "name", "left_anti", start).join(chunks, "name", "left").unionByName(looked_up(looked_up(references, hot, "name", "left_semi", start), payloads, "name", "left", start, SENT))
    right = F.when(F.col("stored") == F.col("n"), F.col("payload")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length than its recipe says")).cast("binary"))
    return found.withColumn("payload", right).repartition("start").sortWithinPartitions("start", "at").select("start", "name", "payload", "n")


def _rebuilt(batches: Iterator) -> Iterator[tuple[list[int], list[memoryview]]]:
    """Of batches of _streams: the documents' starts and ids, chunk by chunk, checked against their names."""
    for b in batches:
        n = b.column(3).to_numpy()
        data = b"".join(b.column(2).to_pylist())
        width = len(data) // max(int(n.sum()), 1)
        view = memoryview(np.frombuffer(data, dtype=f"<u{width or 2}").astype("<u4")).cast("B")
        ends = (4 * np.cumsum(n)).tolist()
        pieces = [view[a:z] for a, z in zip([0, *ends], ends)]  # noqa: B905
        if [name_of(x) for x in pieces] != b.column(1).to_pylist():
            raise ValueError("a chunk's content doesn't have its name")
        yield b.column(0).to_pylist(), pieces


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every document, from chunks and recipes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        current = None
        done: tuple[list, list] = ([], [])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(done[0], type=pa.int64()), pa.array(done[1], type=pa.binary())], ["start", "ids"])

        for starts, pieces in _rebuilt(batches):
            for start, piece in zip(starts, pieces, strict=True):
                if start != current and current is not None:
                    done[0].append(current)
                    done[1].append(b"".join(held))
                    held = []
                current = start
                held.append(piece)
            held = [bytes(x) for x in held]
            yield out()
            done = ([], [])
        if current is not None:
            done[0].append(current)
            done[1].append(b"".join(held))
            yield out()

    verify(spark, folder)
    found = _streams(spark, folder).mapInArrow(run, "start long, ids binary")
    return _recipes(spark, folder).select("start", "doc_id").join(found, "start").select("doc_id", "start", "ids")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: every id stream is put together as by
    read_ids, and summed on the way."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, crc, n = None, 0, 0
        for starts, pieces in _rebuilt(batches):
            done = []
            for start, piece in zip(starts, pieces, strict=True):
                if start != current:
                    if current is not None:
                        done.append((current, n, crc))
                    current, crc, n = start, 0, 0
                crc = zlib.crc32(piece, crc)
                n += len(piece) // 4
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], type=pa.int64()) for i in range(3)], ["start", "read", "ids_crc32"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.int64()) for x in (current, n, crc)], ["start", "read", "ids_crc32"])

    verify(spark, folder)
    with shuffles_freed(spark):
        sums = staged(_streams(spark, folder).mapInArrow(run, "start long, read long, ids_crc32 long"), "stream-sums")
    return _recipes(spark, folder).select("doc_id", "start", "n_tokens").join(sums, "start").select("doc_id", "start", F.col("read").alias("n_tokens"), "ids_crc32")
