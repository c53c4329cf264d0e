"""Token ids of whole texts by the tokenizers library, through a bounded cache of text pieces."""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

from pixelweave.llm.common import release

#: Unicode's White_Space, the characters that both vocabularies' patterns take as white space.
_W = "\t-\r \x85\xa0  -     　"
#: Pieces that a byte-level pattern never crosses: a word with the space before it, or white space without that space.
_BYTE_LEVEL = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]")
#: Pieces for a vocabulary that drops white space.
_WORDS = re.compile(f"[^{_W}]+")
#: Pieces in the younger of the cache's two halves; when it is full it becomes the older one, which is then forgotten.
CACHE = 400_000
#: Marks that no pattern joins to a letter or digit before them.
MARKS = ".,;:!?"
#: The bytes that stand for themselves in byte-level vocabularies; the others are U+0100 and on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words of characters below this one are lower-cased and composed alike everywhere.
_PLAIN = "\u0250"


class Encoder(dict):
    """Maps a piece to the little-endian bytes of its ids; the same ids as encoding the whole text at once.

    Both vocabularies split at white space before merging, so a text's ids are its pieces' ids in a row; so are those of
    a word and the marks that end it. Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        byte_level = self.tokenizer.pre_tokenizer.__class__.__name__ == "ByteLevel"
        self.pieces = (_BYTE_LEVEL if byte_level else _WORDS).findall
        self.merge = self.tokenizer.model.tokenize
        self.lowers = not byte_level
        self.older: dict[str, bytes] = {}
        self.cache = cache

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            stem = piece.rstrip(MARKS)
            if len(stem) < len(piece) and stem[-1:].lower()[-1:].isalnum():  # some letters lower-case to a letter and a mark
                out = self[stem] + self[piece[len(stem) :]]
            else:
                ids = array("H" if self.dtype.itemsize == 2 else "I", self.fresh(piece))
                if sys.byteorder == "big":
                    ids.byteswap()
                out = ids.tobytes()
        if len(self) >= self.cache:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def fresh(self, piece: str) -> list[int]:
        """A piece's ids by the library: a word of Latin letters is one pre-token, so it goes straight to the merges."""
        plain = piece.lower() if self.lowers else piece
        word = plain.removeprefix(" ")
        if word.isalpha() and (word.isascii() or max(word) < _PLAIN):
            return [t.id for t in self.merge(plain.encode().decode("latin-1").translate(_BYTES))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join([self[p] for p in self.pieces(text or "")]), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """This worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache = cache
    return _encoders[path]


def forget() -> None:
    """Frees this worker's encoders; other operators call it, as Spark keeps workers from stage to stage."""
    _encoders.clear()
    release()


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
