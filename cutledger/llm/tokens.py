"""Ids of a public tokenizer, one process at a time."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: The vocabulary file's place is a parameter; this is its usual name.
VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Stands before the first word of a line, which has no blank before it.
_FIRST = "\x00"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts made of these alone are cut here as the tokenizer cuts them; all others it cuts itself.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"[{_LATIN}!-@\[-`{{-~ \n]*")
_CUT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|\n")
_PROBES = ["then", " then.", " it's", "it'll", " 's", " a1b22", " (x)--", "'tis", " Él", "señor,", " 3.5%", " ½", " naïve's"]


def _shown() -> dict[int, str]:
    """The sign by which the vocabulary writes each byte: itself where it can be seen, else the next free one."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces by the tokenizer's own model, found when first asked for."""

    def __init__(self, model, code: str):
        self.model, self.code, self.shown = model, code, _shown()

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece != "\n":
            shown = self.shown[0x20] + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self.shown)
        ids = self[piece] = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids


class _Words(dict):
    """Ids of words by the whole tokenizer: with the blank before it, or, behind _FIRST, without."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, key: str) -> bytes:
        if key == "\n":
            return self.encoder.line
        ids = self[key] = self.encoder.ids(key[1:] if key[0] == _FIRST else " " + key)
        return ids


class Encoder:
    """Encodes whole texts, with a bounded memory of pieces and words.

    Where words are parted by single blanks and line feeds only, the tokenizer never looks beyond
    a word: a blank belongs to the word after it, a line feed is a piece of its own. So the ids of
    such a text are those of its words, one after the other. A text of plain letters, digits and
    signs is cut here into the pieces that the tokenizer's model works on; other words go through
    the whole tokenizer. What came before need not be encoded again. A text with other white space
    or with the string of a special token is encoded as a whole. Ids are little-endian numbers of
    `dtype`.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line, self.most = self.ids("\n"), most
        self.pieces, self.words = _Pieces(self.tokenizer.model, self.dtype.char), _Words(self)
        # Another vocabulary file may cut otherwise; then nothing is cut here, and where a line feed
        # is not one id, nothing is parted.
        self.parts = len(self.line) == self.dtype.itemsize
        self.cuts = self.parts and all(self._cut(x) == self.ids(x) for x in _PROBES if _SIMPLE.fullmatch(x))
        self.pieces.clear()

    def ids(self, text: str) -> bytes:
        return array(self.dtype.char, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _CUT.findall(text)))

    def _one(self, text: str) -> bytes:
        if not self.parts or any(t in text for t in self.special):
            return self.ids(text)
        if self.cuts and _SIMPLE.fullmatch(text) and not any(t in text for t in ("  ", "\n\n", " \n", "\n ")) and text.strip(" \n") == text:
            return self._cut(text)
        if _FIRST not in text and " ".join(text.split()) == text.replace("\n", " "):
            keys = (_FIRST + text.replace("\n", f" \n {_FIRST}")).split(" ")
            return b"".join(map(self.words.__getitem__, keys)) if text else b""
        return self.ids(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for x in texts:
            out.append(self._one(x))
            if len(self.pieces) + len(self.words) > self.most:
                self.pieces.clear()
                self.words.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    return Encoder(path)


def runs(lengths: list[int], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that are short enough to be worked on together."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)
