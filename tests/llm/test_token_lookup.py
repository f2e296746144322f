"""Remembered words: the library's ids, and no word encoded twice for the mark behind it."""

from __future__ import annotations

import public_tokenizers
from palisand.llm.token_ids import Encoder, Lookup


def test_a_word_is_encoded_once_whatever_follows_it():
    made = []
    lookup = Lookup(public_tokenizers.PATTERN, lambda m: made.append(m) or [len(m)])
    lookup.ids("so word word, word. word;\nand word! word? word:")
    assert made.count(" word") == 1


def test_ids_of_words_and_marks_are_the_librarys():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a word, an Übung. it's 'tis we'll' x1, 1. ½; ...! a.b, é́, ªº? 漢字: end.\nNext ,, .a b, c ,  .", "word", " , ", "Ünder\tTab, x", "a,b c,d e,", "don't, I'm. you're? he'd!", "ᵃᵇ, ǅ. ١٢, _a, a_."]
    for text in texts:
        encoded = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.lookup.ids(text) == b"".join(i.to_bytes(4, "little") for i in encoded), text
