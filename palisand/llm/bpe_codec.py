"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The rank file's byte strings become pieces, each byte written as one printable
character, scored by their negative rank; the model file is serialised
directly, with identity normalisation and neither a dummy prefix nor escaped
or removed spaces.  sentencepiece then merges the pair of best score, that is of lowest
rank, leftmost first: the merges of a byte-level BPE.  Texts are split by the
pattern, each match is encoded by itself (once per task, then looked up), and ids
are decoded by the inverse mapping from id to bytes.

Cases: null and empty texts have no ids and decode to no bytes; repeated rows each
keep their row; very long texts and matches are whole; strings of special tokens
are ordinary text; ids outside the vocabulary are an error; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from palisand.llm.shared import one_thread
from palisand.llm.token_ids import Lookup, byte_letters, packed_ids

#: Fixed values of sentencepiece's model format: piece types and the model type BPE.
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: Rows that are held as Python objects at a time.
AT_ONCE = 500


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _whole(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _block(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _score(number: int, value: float) -> bytes:
    return _varint(number << 3 | 5) + struct.pack("<f", value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i; one unknown piece follows them."""
    letters = byte_letters()
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + _score(2, score) + _whole(3, kind))
    pieces = [piece("".join(letters[b] for b in t), -float(rank), NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, UNKNOWN))
    trainer = _whole(3, BPE) + _whole(4, len(pieces)) + _whole(40, len(tokens))
    identity = _block(1, b"identity") + _whole(3, 0) + _whole(4, 0) + _whole(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, identity)


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        one_thread()
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(read_ranks(path)))
        letters = {b: ord(c) for b, c in byte_letters().items()}
        self.written = lambda match: match.encode().decode("latin-1").translate(letters)
        self.processor = processor
        self.lookup = Lookup(pattern, lambda match: processor.encode(self.written(match), out_type=int))

    def learn(self, texts: list[str | None]) -> None:
        """Encode what is new in these texts in one call."""
        known = self.lookup
        words = {w for t in texts if t for w in t.split(" ")} - known.words.keys()
        parts = {w: [" " + w] if w.isalpha() else known.find(" " + w) for w in words if w and not w[0].isspace() and not w[-1].isspace()}
        new = list({m for ms in parts.values() for m in ms} - known.matches.keys())
        ids = self.processor.encode([self.written(m) for m in new], out_type=int, num_threads=1)
        found = dict(zip(new, map(packed_ids, ids), strict=True))
        for w, ms in parts.items():
            known.words[w] = b"".join(found[m] if m in found else known.matches[m] for m in ms)
        known.matches.update((m, found[m]) for m in new if not m[1:].isalpha())

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.lookup.ids(text or ""), dtype="<u4")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes]:
    return read_ranks(path)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                texts = b.column(1).to_pylist()
                c.learn(texts)
                found = [c.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the bytes that they stand for, of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        look = tokens(path).__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                ids = (np.array(x.values.to_numpy(), dtype=np.int64) if x.is_valid else np.empty(0, dtype=np.int64) for x in b.column(1))
                data = pa.array([b"".join(map(look, x.tolist())) for x in ids], type=pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], ["doc_id", "ids", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, data binary")
