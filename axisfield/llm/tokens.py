"""Public tokenizers with word caches: exact ids or counts at a fraction of a full encode.

Both caches rest on the vocabulary never joining text across the places where words are
split, so a text's tokens are its words' tokens in order. Whatever the split can't
express (control characters, letters that the library composes or lower-cases otherwise) is
given to the library whole. A cache is cleared when it is full, so its memory is bounded; that
changes speed only.

Defined results: an empty text has no tokens (callers give empty texts for nulls); a text of any length
is encoded whole; equal texts give equal ids, whatever was encoded before.
"""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np
import regex

#: Distinct words a worker keeps.
CACHE_WORDS = 200_000

# fixed values: the word pattern of the vocabulary file's pre-tokenizer
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters are composed, lower-cased and split alike by Python and the library.
_CONTROL = regex.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž]*")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


class WordIds:
    """Ids of a lower-casing word-end BPE in a `tokenizers` file, without special tokens being added."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.words = cache_words, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" in text or not (text.isascii() and not _CONTROL.search(text) or _PLAIN.fullmatch(text)):
            return self.whole(text)
        parts = _WORD.findall(unicodedata.normalize("NFC", text).lower())
        known = self.words
        try:
            return b"".join([known[w] for w in parts])
        except KeyError:
            own = {*parts}
            new = [w for w in own if w not in known]
            if len(known) + len(new) > self.most:
                known.clear()
                new = [*own]
            model = self.tokenizer.model
            for w in new:
                spelt = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS)
                known[w] = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(spelt)])
            return b"".join([known[w] for w in parts])


class PieceCounts:
    """Token counts of a sentencepiece model none of whose pieces joins a word to the space after it."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.words = cache_words, {}
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def count(self, text: str) -> int:
        words = text.split(" ")
        if not self.splits or "" in words or "▁" in text:
            return self.whole(text)
        known = self.words
        try:
            return sum([known[w] for w in words])
        except KeyError:
            new = [w for w in {*words} if w not in known]
            if len(known) + len(new) > self.most:
                known.clear()
                new = [*{*words}]
            known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
            return sum([known[w] for w in words])


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@functools.cache
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)
