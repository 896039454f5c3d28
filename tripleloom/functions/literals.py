"""Strings of literals: escapes of the text formats, and the canonical form used in keys."""

from __future__ import annotations

import re

# The escapes of N-Triples and Turtle.
_NAMED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_MUST = re.compile(r'[\\"\n\r\t\b\f]')
_CODE = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def unescape(body: str) -> str:
    """The text that an escaped body stands for; unknown escapes and code points stay as they are."""
    if "\\" not in body:
        return body

    def one(m: re.Match) -> str:
        code = m[1] or m[2]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]
        return _NAMED.get(m[3], m[0])

    return _ESCAPE.sub(one, body)


def escape(text: str) -> str:
    return _MUST.sub(lambda m: _CODE[m[0]], text)


def canonical(body: str) -> str:
    """An escaped body with only the escapes that a key needs."""
    return escape(unescape(body)) if "\\" in body else body
