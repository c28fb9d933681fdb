"""Encoding of many texts with a tokenizers file, with every distinct piece merged once per worker.

A text is cut where the file's own rules always cut (white space), each chunk is looked up, and only unknown chunks go through the
pre-tokenizer pattern and the library's merges. Where those cuts are not certain (adjacent white space, code points on which the
``regex`` module and the library might disagree), the text goes to the library whole. So results equal the library's for any text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Chunks kept at once; the older half is given up beyond it, so a worker's memory is bounded. A chunk is kept when it comes a second
#: time, told by a table of marks.
CACHED_CHUNKS = 700_000
MARKS = 1 << 22
CACHED_PIECES = 100_000

#: The patterns that the two tokenizer files name for cutting text before merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@cache
def disputed() -> frozenset[str]:
    """Code points whose letter, number or space class might differ between Unicode versions, or that Python and the patterns
    treat differently: unassigned here, private, or white space for only one of them."""
    space = regex.compile(r"\s")
    out = set()
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c) in ("Cn", "Cs", "Co") or c.isspace() != bool(space.match(c)):
            out.add(c)
    return frozenset(out) | frozenset("\x1c\x1d\x1e\x1f\x85")


_ASCII = re.compile(r"[\x00-\x1b\x20-\x7f]*")


class _Aged(dict):
    """A dict of computed values in two generations: what was not asked for while the newer one filled up is forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key):
        if key in self.old:
            value = self.old[key]
        else:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Chunks(dict):
    """Values of chunks that come again, in two generations like ``_Aged``. Letters, also before a comma or full stop, take the short way."""

    def __init__(self, enc: Encoder, value, most: int):
        super().__init__()
        self.enc, self.value, self.most, self.old = enc, value, most // 2, {}
        self.lead = "" if enc.words else " "
        self.marks = {c: value(c) for c in ",."}
        self.disputed = disputed()
        self.seen = bytearray(MARKS)

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            mark = hash(chunk) % MARKS
            again = self.seen[mark]
            self.seen[mark] = 1
            if chunk.isalpha():
                if chunk.isascii():
                    value = self.value(self.lead + (chunk.lower() if self.enc.words else chunk))
                elif not self.enc.words and self.disputed.isdisjoint(chunk):
                    value = self.value(self.lead + chunk)
            elif chunk[-1:] in self.marks and chunk[:-1].isalpha() and (not self.enc.words or chunk.isascii()):
                value = self[chunk[:-1]]
                if value is not None:
                    value = value + self.marks[chunk[-1]]
            if value is None:
                value = self.enc.slow_chunk(chunk, self.value)
            if not again:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.seen = bytearray(MARKS)
        self[chunk] = value
        return value


class Encoder:
    """``ids(text)`` and ``count(text)`` for a byte-level or a word-level BPE file."""

    def __init__(self, path: str, kept: int = CACHED_CHUNKS):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.words = self.model.end_of_word_suffix is not None and self.model.end_of_word_suffix != ""
        self.pattern = regex.compile(WORD_LEVEL if self.words else BYTE_LEVEL)
        self.letters = dict(enumerate(byte_letters()))
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.mark = "<|"
        spaces = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()] if self.words else []
        self.odd_spaces = [c for c in spaces if self.library.normalizer.normalize_str(f"a{c}a") != "a a"]
        assert all(s.startswith(self.mark) for s in self.special)
        self.pieces = _Aged(self.merge, CACHED_PIECES)
        self.chunks = _Chunks(self, self.merge, kept)

    def tokens(self, piece: str) -> list:
        """The library's merges on one piece."""
        if piece.isascii() and piece.isprintable():  # of these only the space has another letter
            return self.model.tokenize(piece.replace(" ", self.letters[32]))
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))

    def merge(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.tokens(piece)]).tobytes()

    def certain(self, text: str) -> bool:
        if text.isascii():
            return text.isprintable() or _ASCII.fullmatch(text) is not None
        return disputed().isdisjoint(text)

    def split(self, text: str) -> list[str]:
        """The pieces of a text that merges never join; letters with a comma or full stop need no pattern."""
        if self.words:
            text = text.lower() if text.isascii() else self.library.normalizer.normalize_str(text)
            word = text
        else:
            word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return [text]
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def whole_only(self, chunk: str) -> bool:
        """Whether a chunk's text must be taken whole: white space meets white space at its ends, or a disputed code point."""
        return not self.words and (not chunk or chunk[0].isspace() or chunk[-1].isspace()) or not self.certain(chunk)

    def lead(self, chunk: str) -> str:
        return chunk if self.words else " " + chunk

    def chunks_of(self, text: str) -> list[str]:
        """A byte-level text cut at its spaces and, where they stand alone, before its line ends."""
        return (text if "\n\n" in text else text.replace("\n", " \n")).split(" ")

    def slow_chunk(self, chunk: str, value):
        """The summed values of the pieces of a chunk that is not the first; None where its text must be taken whole."""
        line = not self.words and chunk[:1] == "\n" and len(chunk) > 1  # a line end, then a word without a space before it
        if self.whole_only(chunk[1:] if line else chunk):
            return None
        first, *rest = ("\n", *self.split(chunk[1:])) if line else self.split(self.lead(chunk))
        total = value(first)
        for piece in rest:
            total = total + value(piece)
        return total

    def _whole(self, text: str) -> bytes:
        if self.certain(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first = b""
        if self.words:
            if any(c in text for c in self.odd_spaces):
                return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
            chunks = text.split()
        else:
            head, *chunks = self.chunks_of(text)
            if head:
                if self.whole_only(head):
                    return self._whole(text)
                first = b"".join(map(self.pieces.__getitem__, self.split(head)))
        try:
            return first + b"".join(map(self.chunks.__getitem__, chunks))
        except TypeError:  # a None among them
            return self._whole(text)

    def data(self, text: str) -> bytes:
        """Ids as the bytes of an array of ``dtype``."""
        if self.mark not in text:
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(array(self.code, [self.special[t]]).tobytes() if k % 2 else self._plain(t) for k, t in enumerate(parts))

    def ids(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        return np.frombuffer(self.data(text), self.dtype).astype(np.uint32)


@cache
def encoder(path: str, kept: int = CACHED_CHUNKS) -> Encoder:
    """One per worker process and file."""
    return Encoder(path, kept)
