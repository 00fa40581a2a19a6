"""Encoding whole texts with public tokenizers, one library call per distinct word.

A text is cut where every rule of its tokenizer has a boundary, so the ids of
the text are those of its pieces in a row.  ``word_bpe_49k.json`` drops white
space and is cut at ASCII white space; ``byte_bpe_50k.json`` keeps it and is
cut before it.  Each distinct piece goes through the tokenizers library when
a task first meets it, and its ids are gathered from memory after that.
Tests hold the result against encoding the whole text in one call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

CHUNK_CHARS = 1_000_000
MEMORY_WORDS = 500_000
MEMORY_IDS = 5_000_000

#: Characters of the property White_Space, which is what the tokenizers' patterns call white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: letters (ASCII or Latin-1, as UTF-8), then punctuation other than the apostrophe, which may start a contraction
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_MARKS = rb"[!-&(-/:-@\[-`{-~]*"
_WORD = re.compile(rb"(" + _LETTERS + rb")(" + _MARKS + rb")")
_SPACED_WORD = re.compile(rb"( ?" + _LETTERS + rb")(" + _MARKS + rb")")
_SPACED_RUN = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 ones stand for
    themselves, the others for the code points from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = byte_letters()


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def chunks(texts):
    """(from, to) slices of a list of texts of about CHUNK_CHARS characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the runs start[i] .. start[i] + size[i], one after another."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


class _Numbers(dict):
    """Word -> number in order of first sight; ``fresh`` lists the words not learned yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Ids of texts.  Remembers up to MEMORY_WORDS pieces, beyond that those met more than once.

    A subclass cuts a text into pieces at boundaries of its tokenizer, and
    tells the letters of a piece from the punctuation after them, between
    which there is a boundary too.  The letters, normalised, are one unit of
    the tokenizer's model; other pieces go through the whole tokenizer.
    """

    letters_then_marks: re.Pattern

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are remembered here
        self._forget()

    def split(self, text: str) -> list[bytes]:
        raise NotImplementedError

    def normal(self, letters: bytes) -> bytes:
        return letters

    def _forget(self):
        self.number = _Numbers()
        self.ids = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int64)

    def _shrink(self):
        """Forget the words met once; all of them if that frees little."""
        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > len(self.number):
            return self._forget()
        words = list(self.number)
        size = self.size[keep]
        ids = self.ids[ragged(self.start[keep], size)]
        self.number = _Numbers()
        self.number.update((words[i], n) for n, i in enumerate(keep.tolist()))
        self.ids, self.size, self.start, self.met = ids, size, np.cumsum(size) - size, np.zeros(len(keep), dtype=np.int64)

    def _learn(self):
        number, model, known = self.number, self.model, len(self.number) - len(self.number.fresh)
        joint, unit, other = [], [], []
        for i, word in enumerate(number.fresh, known):  # grows by the parts that are new
            cut = self.letters_then_marks.fullmatch(word)
            if not cut:
                other.append((i, word.decode("utf-8")))
            elif (stem := self.normal(cut[1])) != word:
                joint.append((i, number[stem], number[cut[2]] if cut[2] else -1))
            else:
                unit.append((i, word.decode("latin-1").translate(_BYTE_LETTERS)))
        ids = [[t.id for t in model.tokenize(w)] for _, w in unit]
        ids += [e.ids for e in self.tokenizer.encode_batch_fast([w for _, w in other], add_special_tokens=False)]
        at = np.array([i for i, _ in chain(unit, other)], dtype=np.int64)
        grown = len(number) - known
        self.start, self.size, self.met = (np.concatenate([x, np.zeros(grown, dtype=np.int64)])
                                           for x in (self.start, self.size, self.met))
        self.size[at] = size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.start[at] = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum()))])
        if joint:
            own, parts = np.array(joint, dtype=np.int64)[:, 0], np.array(joint, dtype=np.int64)[:, 1:]
            sizes = np.where(parts >= 0, self.size[parts], 0)
            more = self.ids[ragged(self.start[parts].ravel(), sizes.ravel())]
            self.size[own] = both = sizes.sum(axis=1)
            self.start[own] = len(self.ids) + np.cumsum(both) - both
            self.ids = np.concatenate([self.ids, more])
        number.fresh = []

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of every text, int32; none for a null text."""
        return list(self.encode_each(texts))

    def encode_each(self, texts: list) -> Iterator[np.ndarray]:
        """The same one after another, holding the ids of about CHUNK_CHARS characters at a time."""
        for a, b in chunks(texts):
            if len(self.number) > MEMORY_WORDS or len(self.ids) > MEMORY_IDS:
                self._shrink()
            split = [self.split(t) if t else [] for t in texts[a:b]]
            edge = np.cumsum([0] + [len(ws) for ws in split])
            word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(edge[-1]))
            if self.number.fresh:
                self._learn()
            self.met += np.bincount(word, minlength=len(self.met))
            size = self.size[word]
            ids = self.ids[ragged(self.start[word], size)]
            ends = np.concatenate(([0], np.cumsum(size)))
            for x, y in zip(edge[:-1], edge[1:]):
                yield ids[ends[x]:ends[y]]


class WordEncoder(Encoder):
    """``word_bpe_49k.json``: lower case, white space dropped."""

    letters_then_marks = _WORD

    def split(self, text: str) -> list[bytes]:
        return text.encode("utf-8").split()

    def normal(self, letters: bytes) -> bytes:
        return letters.lower() if letters.isascii() else letters.decode("utf-8").lower().encode("utf-8")


class ByteEncoder(Encoder):
    """``byte_bpe_50k.json``: lossless; a word takes the space before it along.  Pieces are white space and the word after it."""

    letters_then_marks = _SPACED_WORD

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        #: bytes that each id stands for
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)

    def split(self, text: str) -> list[bytes]:
        return [p.encode("utf-8") for p in _SPACED_RUN.findall(text)]
