"""Encoding with a public tokenizer file, fast enough for whole corpora.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its
white-space-separated chunks in turn. Each worker keeps the ids of chunks it has met lately, in two
generations of CACHE entries at most (some 40 MB each), so memory stays bounded. A chunk of plain Latin letters, digits and
signs skips the general normaliser, which changes nothing in it but case, and goes to the library's
BPE model piece by piece; any other chunk is encoded by the library as it is.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

CACHE = 250_000
#: Characters that normalisation leaves alone apart from case; none of them is white space.
_PLAIN = re.compile("[!-~¡-įı-ɏ]+")
#: Signs that often end a chunk; a run of them is one piece.
_SIGNS = b".,;:!?*$%&"
#: The pre-tokenizer's pattern: a fixed value of the vocabulary file.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Recent(dict):
    """A cache of ``make``'s values in two generations: a full one becomes the old one, what is met again comes back from it."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = Recent(self._chunk, cache)

    def _chunk(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_SIGNS)
        if core.isalpha():  # letters of ASCII alone, then signs: two pieces
            rest = chunk[len(core) :]
            ids = self._piece(core.lower().decode())
            return ids + (self.chunks[rest] if len(rest) == 1 and core else self._piece(rest.decode())) if rest else ids
        text = chunk.decode()
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            return b"".join(map(self._piece, _PIECE.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        own = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(own)}I", *own)

    def encode(self, text: bytes) -> bytes:
        # Case of ASCII letters never matters, but in the names of special tokens.
        return b"".join(map(self.chunks.__getitem__, (text if b"<|" in text else text.lower()).split()))


_kept: list[tuple] = []


def kept(key, make):
    """The one thing that a worker keeps between tasks: what ``make(key)`` gave, until a task asks for another."""
    if not _kept or _kept[0][0] is not key and _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make(key)))
    return _kept[0][1]


def encoder(path: str, cache: int = CACHE) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return kept((path, cache), lambda key: WordEncoder(*key))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def as_bytes(column):
    """The values of an Arrow string column as bytes, one at a time; null as empty."""
    import pyarrow as pa

    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""
