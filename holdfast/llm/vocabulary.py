"""Byte-level byte-pair vocabularies in the public ``tokenizers`` JSON layout.

A vocabulary splits text into pieces, turns a piece into initial symbols and knows the rank and the
result of each merge. How the merges are carried out is up to the caller (``bpe``, ``token_counts``).

Pieces of plain text are cut by regular expressions here. Other libraries' Unicode tables differ in
recently assigned characters and in contextual lower case, so a text with a character outside
``PLAIN`` is normalised and cut by the normaliser and pre-tokeniser that the file itself describes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex
from tokenizers import Tokenizer

_NOT_PLAIN = re.compile(
    r"[^\x00-\x1b\x20-\u012f\u0131-\u03a2\u03a4-\u0557\u2000-\u2064\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]"
)

# Fixed values of the published vocabularies: how they cut text.
_SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

_SAFE_SPACE = re.compile(r"(?<!\s) (?!\s)")

MEMO_BYTES = 8_000_000
"""Pieces and chunks that a worker remembers, by the bytes of their text; beyond that it starts anew."""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and the cutting rule of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.letters = letters
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + suffix] for c in letters]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for n, (a, b) in enumerate(model["merges"]):
            self.rank[ids[a] << 32 | ids[b]] = n
            self.result.append(ids[a + b] if not suffix else ids[a.removesuffix(suffix) + b])
        self.lower = spec["normalizer"] is not None
        self._own = Tokenizer.from_file(path)
        self._byte = {c: b for b, c in enumerate(letters)}
        parts = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, parts))) if parts else None
        self._mark = "<|" if all(p.startswith("<|") for p in parts) else ""

    def symbols(self, piece: bytes) -> list[int]:
        """Initial symbols of one piece: one for each byte, the last with the end-of-word mark if there is one."""
        out = [self.inner[b] for b in piece]
        if out:
            out[-1] = self.last[piece[-1]]
        return out

    def units(self, text: str) -> list[str | bytes]:
        """A text as units that can be encoded one by one: chunks and special strings, or else finished pieces."""
        if self._special is None or self._mark not in text:
            return self._units(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._units(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._units(text[at:])

    def _units(self, text: str) -> list[str | bytes]:
        if _NOT_PLAIN.search(text):
            return self._library_pieces(text)
        if self.lower:
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return text.lower().split()
        first, *rest = _SAFE_SPACE.split(text)
        return [first, *[" " + x for x in rest]]

    def cut(self, chunk: str) -> list[bytes]:
        """The pieces of a chunk."""
        return [x.encode() for x in (_WORDS if self.lower else _SPACED).findall(chunk)]

    def _library_pieces(self, text: str) -> list[bytes]:
        own = self._own
        text = own.normalizer.normalize_str(text) if own.normalizer else text
        cut = own.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self._byte.__getitem__, piece)) for piece, _ in cut]


class Remembered:
    """Solves the pieces of many texts at once and remembers what it has solved.

    ``solve`` gives the values of distinct pieces, ``join`` the value of several in a row.
    """

    def __init__(self, v: Vocabulary, solve: Callable[[list[bytes]], list], join: Callable, special: Callable[[int], object]):
        self.v, self.solve, self.join = v, solve, join
        self._specials = {t: special(i) for t, i in v.special.items()}
        self._known: dict = dict(self._specials)
        self._held = 0

    def many(self, texts: list[str]) -> list:
        """The value of each text."""
        if self._held > MEMO_BYTES:
            self._known, self._held = dict(self._specials), 0
        known, v = self._known, self.v
        units = [v.units(t) for t in texts]
        new = set().union(*units).difference(known)
        cut = {u: v.cut(u) for u in new if isinstance(u, str)}
        pieces = list({p for ps in cut.values() for p in ps}.union(u for u in new if isinstance(u, bytes)).difference(known))
        known.update(zip(pieces, self.solve(pieces), strict=True))
        get, join = known.__getitem__, self.join
        for u, ps in cut.items():
            known[u] = join(map(get, ps))
        self._held += sum(map(len, cut)) + sum(map(len, pieces))
        return [join(map(get, u)) for u in units]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    return Vocabulary(path)
