"""Token ids of whole texts with a public word-level BPE, one cached word at a time.

The tokenizer splits at white space before anything else and no rule of it looks across, so the
ids of a text are the ids of its white-space-separated words, one after the other. Each distinct
word is encoded once per worker; a text is then a join of cached byte strings.
"""

from __future__ import annotations

import string
import struct
from functools import lru_cache

from .common import hold

#: Words of a generation. A worker remembers two: words met in the younger stay when the older is let go.
REMEMBERED = 200_000
#: A run of these behind a word is a piece of its own (an apostrophe may begin a contraction).
MARKS = string.punctuation.replace("'", "")


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    letters stand for themselves, the others for letters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """Little-endian unsigned 32-bit ids by word (UTF-8 bytes without ASCII white space)."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.roots: dict[str, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.older_roots: dict[str, bytes] = {}

    def _root(self, word: str) -> bytes:
        """A word of lower-case letters that the normaliser leaves as it is."""
        ids = self.roots.get(word)
        if ids is None:
            ids = self.older_roots.get(word)
            if ids is None:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_byte_letters())
                ids = _packed([t.id for t in self.model.tokenize(spelled)])
            if len(self.roots) >= REMEMBERED:
                self.older_roots, self.roots = self.roots, {}
            self.roots[word] = ids
        return ids

    def _encoded(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        head = word.rstrip(MARKS)
        tail = word[len(head) :]
        # letters below U+0130 are composed already and lower-case one by one
        if head.isalpha() and (head.isascii() or max(head) < "İ"):
            ids = self._root(head.lower())
            if tail:
                ids += self.plain(tail)
        else:
            ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return ids

    def __missing__(self, raw: bytes) -> bytes:
        ids = self.older.get(raw)
        if ids is None:
            ids = self._encoded(raw)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[raw] = ids
        return ids

    def plain(self, marks: str) -> bytes:
        ids = self.roots.get(marks)
        if ids is None:
            ids = self.roots[marks] = _packed(self.tokenizer.encode(marks, add_special_tokens=False).ids)
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """One per worker and vocabulary file."""
    return hold(f"encoder {path}", lambda: WordEncoder(path))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
