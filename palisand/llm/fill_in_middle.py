"""Fill-in-middle: a text is cut into prefix, middle and suffix, and the middle goes to the end.

Cuts are code points, texts are UTF-8.  A batch of texts, which lies in one buffer, gets one bitvector with a set bit wherever a code
point begins, packed into 64-bit words, and a directory of the set bits before each block of words.  Differences of ranks are the texts'
lengths in code points; selecting the bits of the two cuts' ranks gives the bytes to cut at.  So no text is decoded.

Where a text is cut, and whether at all, follows from a hash of seed and doc_id, so a repeated run or a lost task gives the same.

Cases: null text is empty, and the empty text is plain; null doc_id hashes as the empty string; repeated rows give equal rows; texts are
handled in slices of bounded size, one text at least; texts that hold a sentinel are plain; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, from which on they stay plain; and how many of the others are suffix-prefix-middle.
PLAIN_FROM, SPM = 90, 20
#: Bytes of text that are handled at once; 64-bit words in a block of the directory.
SLICE, WORDS = 8 << 20, 8


class Boundaries:
    """Rank and select over the bits of a buffer of UTF-8 at which code points begin."""

    def __init__(self, data: np.ndarray) -> None:
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        block = 8 * WORDS
        self.words = np.concatenate([bits, np.zeros(-len(bits) % block + block, np.uint8)]).view("<u8")  # a block of zeros at the end
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts.reshape(-1, WORDS).sum(axis=1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before these places."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // WORDS
        out = self.before[block] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        for w in range(WORDS - 1):
            out = out + np.where(block * WORDS + w < word, self.counts[block * WORDS + w], 0)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the set bits with these ranks (from 0), which must exist."""
        block = np.searchsorted(self.before, k, side="right") - 1
        rest, word = k - self.before[block], block * WORDS
        for _ in range(WORDS - 1):
            on = rest >= self.counts[word]
            rest = np.where(on, rest - self.counts[word], rest)
            word = np.where(on, word + 1, word)
            # once a word has the bit, rest stays below its count
        bits, place = self.words[word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << half) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            on = rest >= n
            rest, place = np.where(on, rest - n, rest), np.where(on, place + half, place)
            bits = np.where(on, bits >> np.uint64(half), low)
        return (word << 6) + place


def hashes(seed: int) -> list[Column]:
    """h1 to h4: the first four groups of 8 digits of SHA-256 of "seed:doc_id", as numbers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings and where each begins, the end last."""
    wide = "large" in str(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(s))
    rows = docs.select("doc_id", text.alias("text"), marked.alias("marked"), *hashes(seed))
    P, S, M = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def cut(batch):
        import pyarrow as pa

        data, at = _buffer(batch.column(1))
        marks = Boundaries(data)
        first = marks.rank(at)
        n = np.diff(first)
        h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(3, 7))
        one, two = h1 % (n + 1), h2 % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        plain = (n == 0) | batch.column(2).to_numpy(zero_copy_only=False).astype(bool) | (h3 % 100 >= PLAIN_FROM)
        spm = h4 % 100 < SPM
        ends = [at[1:].copy(), at[1:].copy()]
        for k, place in zip((low, high), ends, strict=True):
            inside = k < n  # else the cut is the text's end
            place[inside] = marks.select((first[:-1] + k)[inside])
        raw, out = data.tobytes(), []
        for a, z, i, j, as_is, suffix_first in zip(at[:-1].tolist(), at[1:].tolist(), *(e.tolist() for e in ends), plain.tolist(), spm.tolist(), strict=True):
            if as_is:
                out.append(raw[a:z])
            elif suffix_first:
                out.append(b"".join((S, raw[j:z], P, raw[a:i], M, raw[i:j])))
            else:
                out.append(b"".join((P, raw[a:i], S, raw[j:z], M, raw[i:j])))
        forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            done = 0
            at = _buffer(batch.column(1))[1] if len(batch) else np.zeros(1, np.int64)
            while done < len(batch):
                upto = max(done + 1, int(np.searchsorted(at, at[done] + SLICE, side="right")) - 1)
                yield cut(batch.slice(done, upto - done))
                done = upto

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, from what it became.  No sentinel begins within another or where it meets a text, so the first of each is the right one."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
