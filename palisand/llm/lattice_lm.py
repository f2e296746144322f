"""LM scoring: the likelihood of a text over all segmentations into subwords.

The pieces are those of an existing subword vocabulary, whose scores are negative merge ranks, and, as further pieces of the same lattice, the whole
words that training texts hold WHOLE times or more.  The subwords' probabilities start from the vocabulary's order (a piece of rank r weighs 1 / (r + 10)),
those of whole words from half their counts, and all are re-estimated together: a round sums the expected
counts of all pieces in the training texts, by forward and backward recursion in logarithms over all segmentations of each
distinct word, weighted by its tokens, with one added to every subword's count (so the likelihood with that prior never falls).  Rounds go on until
one gains less than GAIN of the likelihood.  A character that is no piece is spelled by its bytes' pieces.  Words begin
with the vocabulary's word mark.  There is one distribution over what begins a token (subwords, whole words, the end of a text) and one over what goes on
within a word (subwords, the stop), so that probabilities of all words sum to one.

A token's probability is the sum over all its paths, the whole word's one included: a distribution over all words, known or not.
A text's probability is the product over its words and its end.

The base score is that of single words with one added to every count.

Both need, for every distinct word, its count and its probability: the
words are counted by Spark (each task sums first), scored once each, and joined with
the documents.  A whole word's expected count is a column beside its word, so that no vocabulary that grows with the texts is sent anywhere.  The HEAD most frequent words, a bounded number, are sent to all tasks; a
document leaves its sums over those and a row for each other word.

Cases: null and empty texts are the end alone; without training documents every count is 0 and pieces keep the
vocabulary's order; repeated rows each count and are each scored; null doc_id trains (its remainder is not the held-out one);
very long texts and words are whole (a word's recursion takes time in proportion to its length); an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisand.llm.shared import one_thread, released, staged

#: Words whose values are sent to all tasks (about 40 bytes each).
HEAD = 200_000
#: Distinct words that a task holds before it emits their counts.
AT_ONCE = 300_000
#: Training tokens of a word that make it a piece; share of the likelihood that a further round must gain, and rounds at most; characters that
#: are worked on at a time; tasks that words are dealt to, per shuffle partition.
WHOLE, GAIN, ROUNDS, AT_A_TIME, DEALT = 2, 0.001, 30, 40_000, 2
LN10 = math.log(10)
#: Leading bits of a hash by which most strings that are no pieces are told.
NEAR = 20
MARK = "▁"
#: A word that no text holds: the end.
END = b""


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by the hash of their characters, and the numbers of the bytes' pieces; the last number, n, is the end."""

    n: int
    longest: int
    hashes: np.ndarray  # ascending
    numbers: np.ndarray
    byte: np.ndarray
    prior: np.ndarray = field(repr=False)  # counts that are there before any text: of what begins a token, of what goes on (last: the end, the stop)
    start: np.ndarray = field(repr=False)  # log10 probabilities by the vocabulary's order, for both
    near: np.ndarray = field(repr=False)  # by the leading NEAR bits of a hash: whether any piece has them


_TIMES = 0x9E3779B97F4A7C15


def _hashed(h: np.ndarray, length: int) -> np.ndarray:
    x = (h + np.uint64(length)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def vocabulary(pieces: dict[str, float], byte: list[int] | None = None, weights: np.ndarray | None = None) -> Vocabulary:
    """Of pieces (text -> rank, numbered in this order), then, unless given, 256 bytes, then the end."""
    n = len(pieces)
    byte_at = np.arange(n, n + 256) if byte is None else np.array(byte)
    total = (n + 256) if byte is None else max(n, int(byte_at.max()) + 1)
    hashes = np.array([_hashed(np.array([sum(ord(c) * pow(_TIMES, k, 2**64) for k, c in enumerate(reversed(p))) % 2**64], dtype=np.uint64), len(p))[0] for p in pieces], dtype=np.uint64)
    at = np.argsort(hashes)
    if weights is None:
        weights = np.full(total + 1, 1.0 / (max(pieces.values(), default=0) + 10))
        weights[:n] = 1 / (np.array(list(pieces.values())) + 10)
    marked, spells = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
    marked[:n] = [p.startswith(MARK) for p in pieces]
    spells[byte_at] = spells[-1] = True
    prior = np.stack([np.where(marked | spells, 1.0, 0.0), np.where(marked, 0.001, 1.0)])  # a mark within a word is rare
    with np.errstate(divide="ignore"):
        start = np.log10(prior * weights / (prior * weights).sum(axis=1, keepdims=True))
    near = np.zeros(1 << NEAR, dtype=bool)
    near[(hashes >> np.uint64(64 - NEAR)).astype(np.int64)] = True
    return Vocabulary(total, max(map(len, pieces), default=1), hashes[at], at, byte_at, prior, start, near)


def read_vocabulary(path: str) -> Vocabulary:
    """That of a sentencepiece model file."""
    one_thread()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    n = len(plain)
    return vocabulary({sp.id_to_piece(i): -sp.get_score(i) for i in plain}, [n + k for k in range(256)] if len(byte) == 256 else None)


class Lattice:
    """The segmentations of words of one length, all at once."""

    def __init__(self, words: list[str], v: Vocabulary, logs: np.ndarray) -> None:
        m, n = len(words), len(words[0]) + 1
        cp = np.empty((n, m), dtype=np.uint64)  # a word is a column, so that each step works on rows
        cp[0] = ord(MARK)
        cp[1:] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, n - 1).T
        self.v, self.logs, self.n, width = v, logs, n, min(n, v.longest)
        self.piece = np.full((width, n, m), -1, dtype=np.int32)  # of each length - 1 and end
        h = np.zeros((n, m), dtype=np.uint64)
        for k in range(width):  # lengths of k + 1 characters
            h[k:] += cp[: n - k] * np.uint64(pow(_TIMES, k, 2**64))
            x = _hashed(h[k:], k + 1)
            some = v.near[(x >> np.uint64(64 - NEAR)).astype(np.int64)]  # most strings are no pieces, and this tells it of nearly all of them
            y = x[some]
            to = np.minimum(np.searchsorted(v.hashes, y), len(v.hashes) - 1)
            if len(y):
                self.piece[k, k:][some] = np.where(v.hashes[to] == y, v.numbers[to], -1)
        found = np.flatnonzero((self.piece >= 0).any(axis=(1, 2)))
        width = int(found.max(initial=0)) + 1  # no longer piece stands in these words
        self.piece = self.piece[:width]
        logs = np.c_[logs * LN10, [-np.inf, -np.inf]]  # natural ones are faster; the last is of no piece
        self.edge = logs[1, self.piece]
        for k in range(width):  # pieces that begin the word
            self.edge[k, k] = logs[0, self.piece[k, k]]
        # a character that is no piece is spelled by its bytes
        self.spelled = {}
        bare = self.piece[0] < 0
        for c in np.unique(cp[bare]).tolist():
            where = bare & (cp == c)
            numbers = v.byte[list(chr(c).encode("utf-8", "surrogatepass"))]
            self.edge[0][where] = logs[1, numbers].sum()
            self.edge[0, 0][where[0]] = logs[0, numbers[0]] + logs[1, numbers[1:]].sum()
            self.spelled[c] = where, numbers
        self.forward = np.full((n + 1, m), -np.inf)
        self.forward[0] = 0
        for end in range(1, n + 1):
            k = min(end, width)
            self.forward[end] = _log_sum(self.forward[end - k : end][::-1] + self.edge[:k, end - 1])

    def total(self) -> np.ndarray:
        """log10 of each word's probability, the stop included."""
        return self.forward[-1] / LN10 + self.logs[1, -1]

    def expected(self, weight: np.ndarray) -> np.ndarray:
        """How often each piece begins a word, and goes on in it, in the words, each so many times, over all segmentations by their probability."""
        width, n, m = self.edge.shape
        back = np.full((n + 1, m), -np.inf)
        back[n] = 0
        for start in range(n - 1, -1, -1):
            k = min(n - start, width)
            steps = np.arange(k)
            back[start] = _log_sum(back[start + 1 : start + 1 + k] + self.edge[steps, start + steps])
        k, end, word = np.nonzero(~np.isneginf(self.edge))  # most places have no piece
        share = np.exp(self.forward[end - k, word] + self.edge[k, end, word] + back[end + 1, word] - self.forward[-1, word]) * weight[word]
        number, size = self.piece[k, end, word], self.v.n + 1
        real = number >= 0
        count = np.bincount(np.where(k == end, 0, size)[real] + number[real], weights=share[real], minlength=2 * size).reshape(2, size)
        spelled = np.zeros(self.edge.shape[1:])
        spelled[end[~real], word[~real]] = share[~real]
        for where, numbers in self.spelled.values():
            first = spelled[0][where[0]].sum()
            count[0, numbers[0]] += first
            np.add.at(count[1], numbers, spelled[where].sum())
            count[1, numbers[0]] -= first
        count[1, -1] += weight.sum()
        return count


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials along the first axis."""
    top = x.max(axis=0)
    top = np.where(np.isneginf(top), 0, top)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(axis=0))


def lattices(words: list[str], v: Vocabulary, logs: np.ndarray) -> Iterator[tuple[list[int], Lattice]]:
    """Lattices of words, and which words each has."""
    at = sorted(range(len(words)), key=lambda i: len(words[i]))
    while at:
        n = len(words[at[0]]) + 1
        k = 1
        while k < len(at) and len(words[at[k]]) + 1 == n and k * n < AT_A_TIME:
            k += 1
        yield at[:k], Lattice([words[i] for i in at[:k]], v, logs)
        at = at[k:]


def tokenised(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, and its end."""
    return [*(text or "").encode().lower().split(), END]


def word_counts(docs: DataFrame, trains: Column) -> DataFrame:
    """word (binary), c (its tokens in training rows) for every word of docs; c may be 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count: Counter = Counter()
        others: set = set()

        def out():
            rest = others - count.keys()
            return pa.RecordBatch.from_arrays([pa.array([*count, *rest], type=pa.binary()), pa.array([*count.values(), *([0] * len(rest))], type=pa.int64())], ["word", "c"])

        for b in batches:
            for text, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (count if train else others).update(tokenised(text))
                if len(count) + len(others) > AT_ONCE:
                    yield out()
                    count.clear()
                    others.clear()
        yield out()

    return docs.select("text", trains.alias("train")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Estimate:
    """log10 probabilities of subwords (what begins, what goes on); log10 of the sum of all expected counts of what begins a token, by which those of whole words
    are divided; and log10 of the training texts' likelihood with the prior before each round."""

    logs: np.ndarray
    total: float
    trace: list[float]


def _whole(expected, total: float) -> np.ndarray:
    """log10 probabilities of whole words from their expected counts."""
    with np.errstate(divide="ignore"):
        return np.log10(np.asarray(expected, dtype=np.float64)) - total


def estimated(words: DataFrame, v: Vocabulary, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Estimate, DataFrame]:
    """What some rounds over the training words (word, c) give, and word, whole: the expected count of each word as one piece, staged.
    What comes to the driver is bounded by the vocabulary."""
    spark, trace = words.sparkSession, []
    state = words.select("word", "c", F.when((F.col("c") >= WHOLE) & (F.length("word") > 0), F.col("c") / 2).otherwise(F.lit(0.0)).alias("whole"))
    n, held = state.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.rint(F.col("whole") * 1e6).cast("long")), F.lit(0))).first()
    total = math.log10(max(n, 1))
    logs = v.start + np.array([[math.log10(1 - held / 1e6 / max(n, 1))], [0.0]])
    while True:
        sent = spark.sparkContext.broadcast((v, logs, total))

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            vocabulary, now, total = sent.value
            count, likelihood, held = np.zeros((2, vocabulary.n + 1)), 0.0, 0.0
            types = [pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            for b in batches:
                texts = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
                c, own = b.column(1).to_numpy().astype(np.float64), _whole(b.column(2).to_numpy(), total)
                whole = np.zeros(len(texts))
                ends = np.array([not t for t in texts], dtype=bool)
                count[0, -1] += c[ends].sum()
                likelihood += c[ends].sum() * now[0, -1]
                some = np.flatnonzero(~ends)
                for at, x in lattices([texts[i] for i in some], vocabulary, now):
                    at = some[at]
                    spelled = x.total()
                    both = np.logaddexp(spelled * LN10, own[at] * LN10) / LN10
                    whole[at] = c[at] * 10.0 ** (own[at] - both)
                    count += x.expected(c[at] - whole[at])
                    likelihood += float(c[at] @ both)
                held += np.rint(whole * 1e6).sum()
                k = len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole), pa.nulls(k, types[3]), pa.nulls(k, types[4])], ["word", "c", "whole", "piece", "n"])
            count = count.ravel()
            used = np.flatnonzero(count)
            millionths = np.rint(np.r_[1e6 * count[used], 1e6 * likelihood, held]).astype(np.int64)  # whole numbers, whose sum has no order
            k = len(millionths)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in types[:3]), pa.array(np.r_[used, -1, -2]), pa.array(millionths)], ["word", "c", "whole", "piece", "n"])

        after = staged(state.mapInArrow(run, "word binary, c long, whole double, piece long, n long"), "lattice-round")
        got = after.filter("piece is not null").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        piece, n = got["piece"].to_numpy(), got["n"].to_numpy() / 1e6
        trace.append(float(n[piece == -1].sum() + (v.prior * np.where(v.prior > 0, logs, 0)).sum()))
        sent.unpersist()
        if trace[1:]:
            released(state)
        state = after.filter("word is not null").select("word", "c", "whole")
        count = v.prior.copy()
        count.ravel()[piece[piece >= 0]] += n[piece >= 0]
        every = count.sum(axis=1) + np.array([n[piece == -2].sum(), 0.0])
        with np.errstate(divide="ignore"):
            logs, total = np.log10(count / every[:, None]), math.log10(every[0])
        if len(trace) >= rounds or trace[1:] and trace[-1] - trace[-2] < gain * abs(trace[-2]):
            return Estimate(logs, total, trace), state.select("word", "whole")


def scored_words(words: DataFrame, v: Vocabulary, e: Estimate) -> DataFrame:
    """word, c, p (log10 probability; of the end: its own) and spelled (the share of it that segmentations into subwords have), of word, c, whole."""
    sent = words.sparkSession.sparkContext.broadcast((v, e.logs, e.total))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary, now, total = sent.value
        for b in batches:
            texts = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            own = _whole(b.column(2).to_numpy(), total)
            out, share = np.full(len(texts), now[0, -1]), np.ones(len(texts))
            some = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
            for at, x in lattices([texts[i] for i in some], vocabulary, now):
                at = some[at]
                out[at] = np.logaddexp(x.total() * LN10, own[at] * LN10) / LN10
                share[at] = 10.0 ** (x.total() - out[at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.float64()), pa.array(share, type=pa.float64())], ["word", "c", "p", "spelled"])

    return words.select("word", "c", "whole").mapInArrow(run, "word binary, c long, p double, spelled double")


def score(docs: DataFrame, held_out: Column, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = staged(word_counts(docs, ~F.col("held_out")), "word-counts")
    total, distinct = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    v, tasks = read_vocabulary(path), DEALT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    estimate, whole = estimated(counts.filter("c > 0").repartition(tasks, "word"), v)
    known = counts.join(whole, "word", "left").withColumn("whole", F.coalesce("whole", F.lit(0.0)))
    words = staged(scored_words(known.repartition(tasks, "word"), v, estimate), "word-lattices").drop("spelled")
    released(counts)
    base = math.log10(total + distinct + 1)
    head = words.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    sent = spark.sparkContext.broadcast({w: (math.log10(c + 1) - base, p, int(c > 0)) for w, c, p in zip(*(head[x].to_pylist() for x in ("word", "c", "p")), strict=True)})

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["k", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "n"]
        types = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
        get = sent.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows: list[tuple] = []
                for k, doc_id, held, text in zip(*(whole.slice(at, 500).column(i).to_pylist() for i in range(4)), strict=True):
                    found = tokenised(text)
                    b = s = known = 0
                    for w, n in Counter(found).items():
                        v = get(w)
                        if v is None:
                            rows.append((k, None, None, None, None, None, None, w, n))
                        else:
                            b += n * v[0]
                            s += n * v[1]
                            known += n * v[2]
                    rows.append((k, doc_id, held, len(found), known, float(b), float(s), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    once = docs.withColumn("k", F.monotonically_increasing_id()).select("k", "doc_id", "held_out", "text")
    parts = staged(once.mapInArrow(run, f"k long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, n long"), "document-parts")
    rest = parts.filter("word is not null").select("k", "word", "n").join(words, "word")
    rest = rest.groupBy("k").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1) - base)).alias("more_base"),
        F.sum(F.col("n") * F.col("p")).alias("more_score"),
    )
    return parts.filter("word is null").join(rest, "k", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
