"""Token ids of texts with the ``tokenizers`` library, word by word.

A text is cut where one space stands between two characters that are not white
space; pieces tokenise alone as they do in place (the pre-tokenizers of the
vocabularies used here never join across such a space). Pieces repeat, so each
worker keeps the ids of pieces met before, in a table of bounded size. Texts
with other spacing, or with the text of an added token, are encoded whole. If
the vocabulary drops white space, texts are cut at all of it; there texts with
U+001C to U+001F, white space to Python but not to the tokenizer, are whole.
"""

from __future__ import annotations

import os
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark's tasks are the parallelism

_MARKS = "!#$%&()*,./:;<=>?@[]^_`{|}~-"
#: The byte alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the rest follow from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}


class Irregular(Exception):
    """A piece that does not tokenise alone as it does in place."""


class _Known(dict):
    """Ids by piece, filled on demand; emptied when it holds ``room`` pieces."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, piece: str) -> bytes:
        got = self.make(piece)
        if len(self) >= self.room:
            self.clear()
        self[piece] = got
        return got


class Encoder:
    """Encodes texts to arrays of ids like ``Tokenizer.encode(text,
    add_special_tokens=False)``, followed by ``end`` if that is given.

    Pieces carry the space before them if the vocabulary has no normalizer
    (``spaced``); otherwise white space is dropped and letters lower-cased.
    """

    def __init__(self, path: str, end: int | None = None, room: int = 700_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end is None else array("I", [end]).tobytes()
        self.spaced = self.tokenizer.normalizer is None
        self.odd = ["\0", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), *("" if self.spaced else "\x1c\x1d\x1e\x1f")]
        self.tokenize = self.tokenizer.model.tokenize
        self.known = _Known(self._piece, room)
        self.marks = _Known(self._model, room // 10)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, part: str) -> bytes:
        mapped = part.replace(" ", "\u0120") if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; one Latin-1 word with ASCII marks behind it is
        given to the model at once, anything else to the whole tokenizer."""
        if self.spaced and (not piece or piece[-1].isspace() or piece[0] == " " and piece[1].isspace()):
            raise Irregular
        word = piece.rstrip(_MARKS)
        bare = word[1:] if self.spaced and word[:1] == " " else word
        if not bare.isalpha() or not bare.isascii() and max(bare) > "\xff":
            return self._whole(piece)
        plain = word if self.spaced else word.lower()
        if plain == piece:
            return self._model(piece)
        ids = self.known[plain]
        return ids + self.marks[piece[len(word):]] if len(word) < len(piece) else ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return self.end
        if any(a in text for a in self.odd):
            return self._whole(text) + self.end
        pieces = text.replace(" ", "\0 ").split("\0") if self.spaced else text.split()
        try:
            return b"".join(map(self.known.__getitem__, pieces)) + self.end
        except Irregular:
            return self._whole(text) + self.end


_HELD: dict[tuple, Encoder] = {}


def encoder(path: str, end: int | None = None) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, end) not in _HELD:
        _HELD.clear()
        _HELD[path, end] = Encoder(path, end)
    return _HELD[path, end]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
