"""Canonical JSON (RFC 8785) over NFC text, and the hashes made of it."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from json.encoder import encode_basestring as _quoted  # short escapes, the other controls as \u00xx: just what RFC 8785 asks
from typing import Any


def nfc(value: Any) -> Any:
    """Every string of a JSON value, keys included, in normal form C."""
    if isinstance(value, str):
        return value if value.isascii() else unicodedata.normalize("NFC", value)
    if isinstance(value, list):
        return [nfc(v) for v in value]
    if isinstance(value, dict):
        return {nfc(k): nfc(v) for k, v in value.items()}
    return value


def number_text(x: float) -> str:
    """A double as ECMAScript prints it: shortest digits, plain between 1e-7 and 1e21."""
    if not math.isfinite(x):
        raise ValueError("no canonical form for a number that isn't finite")
    if x == 0:
        return "0"
    sign, digits, exponent = "-" if x < 0 else "", *_shortest(abs(x))
    point = exponent + 1  # digits before the decimal point
    if 0 < point <= 21:
        body = digits + "0" * (point - len(digits)) if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        tail = f"{'+' if exponent >= 0 else '-'}{abs(exponent)}"
        body = f"{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{tail}"
    return sign + body


def _shortest(x: float) -> tuple[str, int]:
    mantissa, exponent = f"{x!r}e0".split("e")[:2] if "e" in repr(x) else (repr(x), "0")
    whole, _, fraction = mantissa.partition(".")
    digits, power = (whole + fraction), int(exponent) + len(whole) - 1
    stripped = digits.lstrip("0")
    power -= len(digits) - len(stripped)
    return stripped.rstrip("0") or "0", power


def dumps(value: Any) -> str:
    """RFC 8785: keys by UTF-16 units, no blanks, shortest numbers."""
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, int):
        if abs(value) > 2**53 - 1:
            raise ValueError("an integer that a double can't hold exactly")
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    keys = sorted(value) if all(map(str.isascii, value)) else sorted(value, key=lambda k: k.encode("utf-16-be"))
    return "{" + ",".join([f"{_quoted(k)}:{dumps(value[k])}" for k in keys]) + "}"


_encoder = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False)
#: The library's encoder makes this anew for every value.
_chunks = json.encoder.c_make_encoder and json.encoder.c_make_encoder(None, _encoder.default, _quoted, None, ":", ",", True, False, True)


def _encoded(value: Any) -> str:
    return "".join(_chunks(value, 0)) if _chunks else _encoder.encode(value)


def digest(value: Any, plain: bool = False) -> str:
    """``plain``: no number in ``value`` is a double or of 16 digits and more; the library's text of it is canonical then, if it is ASCII."""
    if not (plain and (text := _encoded(value)).isascii()):
        text = dumps(nfc(value))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
