"""Whole texts to token ids by a tokenizers file, with each distinct word encoded once per worker.

Both kinds of vocabulary split a text before merging, and never merge across the splits, so the ids of a text are those of its
words in turn. A word that is all letters is one split and goes straight to the library's model; marks after a letter are
a split of their own; other words go through the library whole. The byte-level kind gives a word the space before
it: texts whose white space isn't plain (only single spaces and up to two line ends) are cut by the full rule, and those with
white space outside ASCII, where that rule needs more context, are encoded whole. The other kind drops white space and is
split on ASCII white space alone, which its own split never crosses. The library cuts a text at its added tokens (such as an
end mark written out) before all else, so a text that holds one is encoded whole. Agreement with the library, as it is when it
is loaded from the file, is covered by tests.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

_RUNS = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
_UNPLAIN = ("  ", " \n", "\n\n ", "\n\n\n", "\t", "\r", "\x0b", "\x0c", "\x01")
#: Begins the key of a word without a space before it.
_BARE = "\x01"
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Words kept in a worker's cache; it starts anew between texts when they are more.
CACHE_WORDS = 700_000

_WHITE = " \t\n\r\x0b\x0c"
#: After a letter, any of these begins a new split (an apostrophe may not).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letters that stand for bytes in byte-level vocabularies: printed ones for themselves, the rest from U+0100 on.
_BYTE_LETTERS = {b: b if b in _PRINTED else 256 + sum(c not in _PRINTED for c in range(b)) for b in range(256)}

_loaded: dict = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key):
        ids = self[key] = self.encode(key)
        return ids


class Encoder:
    """Ids of a text as little-endian unsigned bytes, ``width`` bytes each (2 if the vocabulary fits, else 4)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.spaced = told["pre_tokenizer"]["type"] == "ByteLevel"
        # in any case of letters, since words are lower-cased before the library sees them
        added = sorted({t["content"] for t in told["added_tokens"]})
        self._added = re.compile("|".join(map(re.escape, added)).encode(), re.IGNORECASE) if added else None
        self.width = 2 if self._lib.get_vocab_size() <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._code = "H" if self.width == 2 else "I"
        self._model = self._lib.model
        self._known = _Known(self._one)
        self._tails: dict = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _pieces(self, raw: bytes) -> list | None:
        """Keys of the words of a text; null if it must be encoded whole."""
        if self._added and self._added.search(raw):
            return None
        if not self.spaced:
            return raw.lower().split()
        text = raw.decode()
        if any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _ODD.search(text):
            return None
        if text[:1] == " " or text[-1:] == " " or text[-2:] == "\n\n" or any(c in text for c in _UNPLAIN):
            return None if _BARE in text else [w[1:] if w[0] == " " and len(w) > 1 and w[1] not in _WHITE else _BARE + w for w in _RUNS.findall(text)]
        return (_BARE + text.replace("\n", " \n " + _BARE)).split(" ")

    def _word(self, lead: str, word: str) -> bytes:
        if word.isalpha() and (self.spaced or word.isascii() or word == word.lower() and unicodedata.is_normalized("NFC", word)):
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            return array(self._code, [t.id for t in self._model.tokenize("\u0120" + word if lead else word)]).tobytes()
        return self._whole(lead + word)

    def _one(self, key) -> bytes:
        word = key if self.spaced else key.decode()
        lead = " " if self.spaced and word != "\n" else ""
        if self.spaced and word[:1] == _BARE:
            lead, word = "", word[1:]
        base = word.rstrip(_MARKS)
        if base and base != word and base[-1].isalpha() and base[-1].isascii():
            tail = word[len(base) :]
            if (end := self._tails.get(tail)) is None:
                end = self._tails[tail] = self._whole(tail)
            return self._known[key[: len(key) - len(tail)]] + end
        return self._word(lead, word) if word else b""

    def encode(self, raw: bytes) -> bytes:
        pieces = self._pieces(raw)
        if pieces is None:
            return self._whole(raw.decode())
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
            self._tails.clear()
        return b"".join(map(self._known.__getitem__, pieces))


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
