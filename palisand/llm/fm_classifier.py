"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs are
summed in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
The last STATS features are statistics of the text's bytes, lines and words; the
others are words (and metadata values) hashed into BUCKETS.  Word weights
have unit length per document.

The model is fitted on at most MAX_TRAIN labelled rows (those of smallest hash,
so always the same ones); everything else, features and scores, covers all rows and whole texts.

Cases: null and empty texts have no words and statistics of zero, and get a score as any other;
null metadata is a value of its own; repeated rows get a score each; rows whose
label is null or that have no label teach nothing, a document with several labels
counts once with the least; of several rows of one doc_id that whose text has the least hash teaches; without any labelled row every score is 0.5; an empty table gives an
empty result; very long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisand.llm.shared import only, remembers, sliced

#: Hash buckets of words and metadata; statistics; width of the factors.
BUCKETS, STATS, FACTORS = 1 << 13, 18, 4
#: Most labelled rows that the model is fitted on.
MAX_TRAIN = 6000
#: Passes over the rows (more of them where they make fewer than STEPS batches).
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 250, 256, 0.03, 1e-4


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray  # (BUCKETS + STATS,)
    factors: np.ndarray  # (BUCKETS + STATS, FACTORS)


_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1  # upper case
_CLASS[97:123] = 2  # lower case
_CLASS[48:58] = 3  # digits
_CLASS[[9, 10, 11, 12, 13, 32]] = 4  # white space
_CLASS[128:] = 5  # beyond ASCII
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 6  # plain punctuation
_CLASS[[ord(c) for c in "!?"]] = 7


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = found = zlib.crc32(word) & (BUCKETS - 1)
        return found


_BUCKETS = _Buckets()
remembers("word buckets", _BUCKETS.clear)


def features(text: str | None, metadata: Sequence[tuple[str, object]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of the hashed features, and the statistics."""
    data = (text or "").encode()
    found = data.split()
    n = len(found)
    at = np.fromiter(map(_BUCKETS.__getitem__, found), dtype=np.int64, count=n)
    count = np.bincount(at, minlength=BUCKETS) if n else np.zeros(BUCKETS, dtype=np.int64)
    index = np.flatnonzero(count)
    value = np.log1p(count[index])
    value /= max(np.sqrt((value**2).sum()), 1e-9)
    if metadata:
        extra = np.array([zlib.crc32(f"{k}={v}".encode()) & (BUCKETS - 1) for k, v in metadata])
        index, value = np.concatenate([index, extra]), np.concatenate([value, np.full(len(extra), 0.3)])
    size = max(len(data), 1)
    share = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=8) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = size - share[4] * size
    share = np.minimum(5 * share, 3)
    same = float((at[1:] == at[:-1]).sum()) / max(n - 1, 1)
    stats = [
        share[0], share[1], share[2], share[3], share[5], share[6], share[7], 3 * same, share[0] > 0.05,
        min(np.log1p(n) / 10, 2), n == 0, n < 20, n < 50,
        min(chars / max(n, 1) / 20, 3),
        len(set(found)) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        min(n / max(len(lines), 1) / 100, 3),
        min(len(index) / max(n, 1), 1),
    ]
    return index, value, np.array(stats, dtype=np.float64)


def _logits(m: Machine, batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear in the number of features, by the sum-of-squares identity."""
    out = np.empty(len(batch))
    w, v = m.linear, m.factors
    w_s, v_s = w[BUCKETS:], v[BUCKETS:]
    for i, (index, value, stats) in enumerate(batch):
        part = v[index] * value[:, None]
        s = part.sum(axis=0) + stats @ v_s
        out[i] = m.bias + w[index] @ value + w_s @ stats + 0.5 * ((s**2).sum() - (part**2).sum() - ((v_s * stats[:, None]) ** 2).sum())
    return out


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Machine:
    """Mini-batch Adam on the logistic loss, both classes weighted alike up to a factor of four."""
    size = BUCKETS + STATS
    rng = np.random.default_rng(seed)
    p = {"b": np.zeros(1), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, FACTORS))}
    if not len(labels):
        return Machine(0.0, p["w"], p["v"] * 0)
    one, first, second, t = labels.mean(), {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(labels == 1, 1.0, np.clip(one / max(1 - one, 1e-9), 0.25, 4.0))
    batches = max(1, len(labels) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    for epoch in range(epochs):
        for pick in np.array_split(rng.permutation(len(labels)), batches):
            x = np.zeros((len(pick), size))
            for r, i in enumerate(pick):
                index, value, stats = rows[i]
                np.add.at(x[r], index, value)
                x[r, BUCKETS:] = stats
            s = x @ p["v"]
            logit = p["b"] + x @ p["w"] + 0.5 * ((s**2).sum(axis=1) - (x**2) @ (p["v"] ** 2).sum(axis=1))
            e = (probability(logit) - labels[pick]) * weight[pick] / len(pick)
            grad = {"b": np.array([e.sum()]), "w": x.T @ e + DECAY * p["w"], "v": x.T @ (e[:, None] * s) - ((x**2).T @ e)[:, None] * p["v"] + DECAY * p["v"]}
            t += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(float(p["b"][0]), p["w"], p["v"])


def remainder(modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def _with_metadata(row_lists: list[list], names: Sequence[str]) -> Iterator[tuple]:
    for text, *rest in zip(*row_lists, strict=True):
        yield features(text, list(zip(names, rest, strict=True)))


def train(docs: DataFrame, labels: DataFrame, metadata: dict[str, Column] | None = None, max_train: int = MAX_TRAIN) -> Machine:
    """A machine from at most max_train rows of labels (doc_id, label) and their documents."""
    metadata = metadata or {}
    chosen = (
        labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    names = ["text", *(f"_m_{k}" for k in metadata)]
    found = docs.select("doc_id", "text", *[c.cast("string").alias(f"_m_{k}") for k, c in metadata.items()]).join(F.broadcast(chosen), "doc_id")
    # of several rows of one doc_id that of the least hash
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64(*names).alias("h"), *names)).alias("d")).select("doc_id", "label", "d.*")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only("word buckets")
        for b in sliced(batches):
            made = list(_with_metadata([b.column(i).to_pylist() for i in range(3, b.num_columns)], list(metadata)))
            columns = [b.column(0), b.column(1), *(pa.array([x[i].astype(np.float64).tolist() for x in made], type=pa.list_(pa.float64())) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "label", "i", "x", "s"])

    plain = found.select(F.xxhash64("doc_id").alias("k"), F.col("label").cast("long").alias("label"), "doc_id", "text", *[f"_m_{k}" for k in metadata])
    table = plain.mapInArrow(read, "k long, label long, i array<double>, x array<double>, s array<double>").toArrow().sort_by("k")
    rows = [(np.array(i.as_py(), dtype=np.int64), np.array(x.as_py()), np.array(s.as_py())) for i, x, s in zip(table["i"], table["x"], table["s"], strict=True)]
    return fit(rows, table["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, keep: Sequence[str] = (), metadata: dict[str, Column] | None = None, within: str | None = None) -> DataFrame:
    """doc_id, the columns of keep, and score (0 to 1) of every row.  The machine travels
    as a broadcast of fixed size: (BUCKETS + STATS) * (FACTORS + 1) numbers.  within: the struct column of keep that holds text, if it is no column of its own."""
    metadata, sent = metadata or {}, docs.sparkSession.sparkContext.broadcast(machine)
    kept = ["doc_id", *keep]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only("word buckets")
        for b in sliced(batches):
            bodies = b.column(kept.index(within)).field("text") if within else b.column(len(kept))
            made = list(_with_metadata([bodies.to_pylist(), *(b.column(i).to_pylist() for i in range(b.num_columns - len(metadata), b.num_columns))], list(metadata)))
            p = probability(_logits(sent.value, made)) if made else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(p, type=pa.float64())], [*kept, "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
    given = docs.select(*kept, *([] if within else [F.col("text").alias("_text")]), *[c.cast("string").alias(f"_m_{k}") for k, c in metadata.items()])
    return given.mapInArrow(run, schema)


def accepted(docs: DataFrame, machine: Machine, least: float) -> DataFrame:
    """The rows of docs, all their columns, whose score is least or more."""
    whole = docs.select("doc_id", F.struct("*").alias("doc"))  # whatever the columns of docs are called
    return score(whole, machine, keep=["doc"], within="doc").filter(F.col("score") >= least).select("doc.*")
