"""Token ids of whole texts, as the tokenizers library gives them, with each distinct piece of a task encoded once.

A text is cut where the tokenizer's own pre-tokenizer always cuts, whatever stands around; ids of the parts are then
the ids of the whole. Which cut is sound is read from the tokenizer's file; where none is known the whole text is
encoded. The cache of pieces lives as long as the Python worker and is bounded: it holds CACHE pieces in two
generations, of which the older one goes when the younger one is full, so that frequent pieces stay.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

CACHE = 500_000
#: Marks that stand alone behind a letter, whatever follows a blank.
TAIL = ".,;:"
_TAILS = frozenset(TAIL)
#: A word and marks, and perhaps a line break and a word: these are four pre-tokens where letters, marks and blanks are told
#: apart, whatever stands around (an apostrophe isn't among the marks).
_MARKED = re.compile(r"([^\W\d_]+)([!?.,;:*#$%&|<>]+)(?:\n([^\W\d_]+))?")
#: A blank before one of these isn't cut: what counts as white space differs between Unicode versions.
_ODD = "\\s\u180e\u200b\u2060\ufeff"
_CUT = re.compile(f" (?=[^{_ODD}])")
_UNSAFE = re.compile(f" (?:\\Z|[{_ODD}])")
#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the rest from U+0100 on.
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}
_BLANK = chr(_SHOWN[0x20])
_LOADED: dict[str, "TextEncoder"] = {}


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, made when first asked for."""

    def __init__(self, encode, prefix="", plain=None):
        super().__init__()
        #: ``plain``: the cache of pieces without a blank, where a word, its marks and what follows are known to be parted.
        self.encode, self.prefix, self.plain, self.older = encode, prefix, plain, {}

    def __missing__(self, piece):
        ids = self.older.get(piece)
        if ids is None:
            text = piece if piece.__class__ is str else piece.decode("utf-8", "replace")
            # A word of plain letters or digits has no mark at its end.
            if text[-1:] in _TAILS and len(text) > 1 and text[-2] < "\u0250" and text[-2].isalpha():
                ids = self[piece[:-1]] + self.bare(text[-1])  # a letter and a mark are always parted
            elif self.plain is None or (ids := self.parted(text)) is None:
                ids = self.encode(self.prefix, text)
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def parted(self, text: str) -> bytes | None:
        """Ids of a word with marks behind it, each part by itself; None of anything else."""
        if text.isalpha() or not (found := _MARKED.fullmatch(text)):
            return None
        word, marks, after = found.groups()
        if max(text) >= "\u0250" or not word.isalpha() or after and not after.isalpha():
            return None
        return self[word] + self.plain[marks] + (self.plain["\n"] + self.plain[after] if after else b"")

    @functools.cache
    def bare(self, mark: str) -> bytes:
        return self.encode("", mark)

    __hash__ = object.__hash__


class TextEncoder:
    """``encode(text) -> bytes`` of little-endian unsigned 32-bit ids, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = self._kind(spec)
        self.tokenize = self.tokenizer.model.tokenize
        self.first, self.words = _Pieces(self.piece), _Pieces(self.piece)
        self.rest = _Pieces(self.piece, " ", self.first)

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens") or [])
        if not plain or spec.get("post_processor"):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "blank"
        steps = pre.get("pretokenizers") or []
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in steps[0]["pattern"].get("Regex", "") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space") and "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            return "word"
        return "whole"

    def piece(self, prefix: str, bare: str) -> bytes:
        """Ids of a word with a blank before it, or nothing (``prefix``)."""
        # A word of Latin letters alone is one pre-token that no normalizer changes: it goes straight to the model. So is one
        # of digits where only blanks, letters, digits and marks are told apart.
        kind = self.kind
        if bare.isascii():
            if kind == "blank" and (bare.isalpha() or bare.isdigit()) or kind == "word" and bare.isalpha() and bare.islower():
                return array("I", [t.id for t in self.tokenize(_BLANK + bare if prefix else bare)]).tobytes()
        elif kind != "whole" and bare.isalpha() and max(bare) < "\u0250" and (kind == "blank" or bare == bare.lower()):
            return array("I", [t.id for t in self.tokenize((prefix + bare).encode("utf-8").decode("latin-1").translate(_SHOWN))]).tobytes()
        return self.library(prefix + bare)

    def whole(self, text: str) -> bytes:
        return self.piece(" ", text[1:]) if self.kind == "blank" and text[:1] == " " else self.piece("", text)

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def task_cache(self) -> "_Pieces":
        """A cache of words that goes with the task."""
        return _Pieces(self.piece)

    def encode(self, text: str) -> bytes:
        if self.kind == "word":
            return b"".join(map(self.words.__getitem__, text.encode("utf-8").lower().split()))
        if self.kind == "whole" or any(s in text for s in self.specials):
            return self.whole(text)
        pieces = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))


def encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]
