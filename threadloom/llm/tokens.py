"""Byte-level BPE with the ``tokenizers`` library, memoised on words.

The vocabulary's pre-tokeniser never joins text across a single space that follows a non-blank, so such
spaces cut a text into chunks that encode independently. Each distinct chunk goes through the library's BPE
model once a worker process; texts are then joined from the memo. A text with a blank before a space is cut by
the pre-tokeniser's own pattern as a whole. ``Encoder.ids`` cuts a text at the vocabulary's added tokens first, and gives the ids of
``Tokenizer.encode(text, add_special_tokens=False)``; ``Encoder.encode`` takes them as ordinary text (``encode_special_tokens``).
"""

from __future__ import annotations

from array import array

import numpy as np
import regex

from threadloom.llm.common import process_cache

#: The Unicode White_Space characters, as in the pre-tokeniser's ``\s``.
SPACE = "\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokeniser's published pattern.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_WIDE = regex.compile(rf"[{SPACE}] ")
_NARROW = tuple(b + " " for b in " \t\n\x0b\x0c\r")
#: Marks that form a piece of their own behind a word.
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Entries of the memo of one worker process; about 250 bytes each.
MEMO = 700_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 upwards."""
    out, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            out[byte] = chr(byte)
        else:
            out[byte], spare = chr(spare), spare + 1
    return out


_encoders: dict[str, "Encoder"] = process_cache()


class _Memo(dict):
    """Bytes by key; a missing key is worked out once."""

    def __init__(self, work):
        super().__init__()
        self._work = work

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self._work(key)
        return value


class Encoder:
    """Token ids of texts as little-endian 16-bit bytes; one instance a vocabulary and process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens must match literally")
        self._added = {t.content: np.array([i], dtype="<u2").tobytes() for i, t in added.items()}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self._added, key=len, reverse=True))) + ")")
        self._tokenize, self._letters = tokenizer.model.tokenize, _byte_letters()
        self._pieces = _Memo(self._piece)
        self._chunks = _Memo(self._chunk)

    def _ids(self, piece: str) -> bytes:
        """Ids of one piece, in the byte-level alphabet."""
        return array("H", [t.id for t in self._tokenize(piece)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters))

    def _chunk(self, rest: str) -> bytes:
        """Ids of a space and the blank-free start of ``rest``; a word with or without one mark behind it needs no pattern."""
        if rest.isalpha():
            return self._ids(self._letters[32] + rest) if rest.isascii() else self._piece(" " + rest)
        if rest[:-1].isalpha() and rest[-1] in _MARKS:
            return self._chunks[rest[:-1]] + self._pieces[rest[-1]]
        return b"".join([self._chunks[p[1:]] if p[0] == " " and p[1:].isalpha() else self._pieces[p] for p in PIECES.findall(" " + rest)])

    def encode(self, text: str) -> bytes:
        if any(x in text for x in _NARROW) or not text.isascii() and _WIDE.search(text):
            return b"".join(map(self._pieces.__getitem__, PIECES.findall(text)))
        if len(self._pieces) + len(self._chunks) > MEMO:
            self._pieces.clear()
            self._chunks.clear()
        first, *rest = text.split(" ")
        return b"".join(map(self._pieces.__getitem__, PIECES.findall(first))) + b"".join(map(self._chunks.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        """As ``encode``, with added tokens as their own ids."""
        if not any(t in text for t in self._added):
            return self.encode(text)
        return b"".join(self._added.get(part) or self.encode(part) for part in self._cut.split(text))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
