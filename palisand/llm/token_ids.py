"""Token ids of whole texts with the tokenizers library.

A byte-level BPE tokenizer without normaliser encodes each match of its
pattern by itself, so matches are encoded once per task with the library's
model and looked up after that.  Texts that hold an added token's string, and tokenizers of
any other make, go through the library's encode() as they are.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from palisand.llm.shared import one_thread, remembers, sliced

#: Words, and matches, that a Python worker remembers before it starts anew (about 200 bytes each).
REMEMBERED = 600_000
#: Marks that are a match by themselves between a letter and a space.
MARKS = frozenset(",.;:!?")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1024)
def _packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _packer(len(ids))(*ids)


class Matches(dict):
    """match of the pattern -> its ids as little-endian unsigned 32-bit integers; encode gives a match's ids."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, match: str) -> bytes:
        self[match] = ids = packed_ids(self.encode(match))
        return ids


class Words(dict):
    """What stands between two spaces -> ids of it and the space before it.

    A space between two characters that aren't white space always begins a match, so texts can be
    parted there.  Where white space adjoins the space, None tells that the text can't."""

    def __init__(self, find: Callable[[str], list[str]], matches: Matches) -> None:
        super().__init__()
        self.find, self.matches = find, matches

    def __missing__(self, word: str) -> bytes | None:
        if word.isalpha():  # letters only: one match
            ids = packed_ids(self.matches.encode(" " + word))
        elif not word or word[0].isspace() or word[-1].isspace():
            ids = None
        elif word[-1] in MARKS and (letters := word[:-1]).isalpha():  # letters and a mark: two matches
            ids = self[letters] + self.matches[word[-1]]
        else:
            first, *rest = self.find(" " + word)
            own = self[letters] if (letters := first[1:]).isalpha() else self.matches[first]
            ids = b"".join([own, *map(self.matches.__getitem__, rest)])
        self[word] = ids
        return ids


class Lookup:
    """Ids of texts by remembered words and matches."""

    def __init__(self, pattern: str, encode: Callable[[str], list[int]]) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.matches = Matches(encode)
        self.words = Words(self.find, self.matches)

    def ids(self, text: str) -> bytes:
        if len(self.matches) > REMEMBERED or len(self.words) > REMEMBERED:
            self.matches.clear()
            self.words.clear()
        first, *rest = text.split(" ")
        found = list(map(self.words.__getitem__, rest))
        if None in found or first[-1:].isspace():
            return b"".join(map(self.matches.__getitem__, self.find(text)))
        return b"".join([*map(self.matches.__getitem__, self.find(first)), *found])


class Encoder:
    def __init__(self, path: str) -> None:
        one_thread()
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        conf = json.loads(self.tokenizer.to_str())
        pre = conf["pre_tokenizer"] or {}
        self.simple = (
            conf["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre["add_prefix_space"]
            and conf["model"]["type"] == "BPE"
        )
        self.added = [t["content"] for t in conf["added_tokens"]]
        self.n_ids = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        tokenize, letters = self.tokenizer.model.tokenize, {b: ord(c) for b, c in byte_letters().items()}
        space = chr(letters[ord(" ")])

        def of_match(m: str) -> list[int]:
            if m[0] == " " and m.isascii() and m[1:].isalpha():  # such letters stand for themselves
                return [t.id for t in tokenize(space + m[1:])]
            return [t.id for t in tokenize(m.encode().decode("latin-1").translate(letters))]

        self.lookup = Lookup(public_tokenizers.PATTERN, of_match)

    def ids(self, text: str | None) -> bytes:
        """The text's ids (null: none) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.simple or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.lookup.ids(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


remembers("token ids", encoder.cache_clear)


def texts(batches: Iterator) -> Iterator[tuple[list, list]]:
    """(first column, second column) of Arrow batches, as Python lists."""
    for b in sliced(batches):
        yield b.column(0).to_pylist(), b.column(1).to_pylist()
