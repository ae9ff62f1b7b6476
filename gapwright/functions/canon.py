"""Canonical JSON: sorted keys, no floats and no nulls, whole numbers within 32 bits (wider ones travel as text), NFC text
without control characters; and a strict parser that refuses what the printer would not print."""

from __future__ import annotations

import json
import unicodedata

U32, U64 = (1 << 32) - 1, (1 << 64) - 1


class CanonError(ValueError):
    """``reason`` says what isn't canonical."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def is_text(s: str) -> bool:
    if s.isascii():  # of ASCII all is NFC, and what isn't printable is a control character
        return s.isprintable()
    return unicodedata.is_normalized("NFC", s) and not any(unicodedata.category(c) == "Cc" for c in s)


def check(value, depth: int = 8) -> None:
    if depth < 0:
        raise CanonError("too_deep")
    if value is None:
        raise CanonError("null")
    if isinstance(value, bool):
        return
    if isinstance(value, float):
        raise CanonError("float_literal", repr(value))
    if isinstance(value, int):
        if not 0 <= value <= U32:
            raise CanonError("width", str(value))
    elif isinstance(value, str):
        if not is_text(value):
            raise CanonError("not_nfc", repr(value))
    elif isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise CanonError("key_form", repr(k))
            check(k, depth)
            check(v, depth - 1)
    elif isinstance(value, (list, tuple)):
        for v in value:
            check(v, depth - 1)
    else:
        raise CanonError("type", type(value).__name__)


def dumps(value) -> str:
    """One line, keys in the order of their UTF-8 bytes."""
    check(value)
    return _print(value)


def _print(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_print(k)}:{_print(value[k])}" for k in sorted(value, key=lambda k: k.encode())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_print, value)) + "]"
    return _ENCODE(value)


def line(value) -> bytes:
    return dumps(value).encode("utf-8") + b"\n"


def _pairs(items):
    out = dict(items)
    if len(out) < len(items):
        raise CanonError("duplicate_key")
    return out


def _no_float(x):
    raise CanonError("float_literal", x)


#: Made once: json.dumps and json.loads make a coder a call where they are given any setting.
_ENCODE = json.JSONEncoder(ensure_ascii=False).encode
_DECODE = json.JSONDecoder(object_pairs_hook=_pairs, parse_float=_no_float, parse_constant=_no_float).decode


def loads(text: str):
    """Parse strictly: duplicate keys, floats and constants such as NaN are refused."""

    try:
        return _DECODE(text)
    except (json.JSONDecodeError, RecursionError) as e:
        raise CanonError("not_json") from e


def decimal(text, bits: int = 64) -> int:
    """A whole number that travels as decimal text: no sign, no leading zero, within its width."""
    if not isinstance(text, str) or not text.isascii() or not text.isdigit() or text != str(int(text)):
        raise CanonError("t_evt_ns_form")
    if int(text) >= 1 << (bits - 1):
        raise CanonError("t_evt_ns_width")
    return int(text)
