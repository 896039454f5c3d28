"""Terms in canonical key form: kinds, parts, order-preserving sort keys.

Keys: ``<iri>``, ``"str"``, ``"str"@lang``, ``"v"^^<datatype>``, bare numbers, ``_:scope/n``, ``<< s p o >>``.
Column expressions run in the JVM; the Python twins are used by parsers, which make keys anyway.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The vocabulary that the data use.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE, RDF_MEMBER, RDF_BAG = f"<{RDF}type>", f"<{RDF}member>", f"<{RDF}Bag>"
INFERRED_FROM = "<https://example.com/inferred_from>"
XSD_STRING = f"<{XSD}string>"

# Rank of each kind in the total order of terms (0 is unbound).
QUOTED, BLANK, IRI, STRING, LANG, INTEGER, DECIMAL, DOUBLE, TYPED = 1, 2, 3, 4, 5, 6, 7, 8, 9

_SUFFIX = '"^^' + XSD_STRING


def plain_string(key: Column) -> Column:
    """``"x"^^xsd:string`` as ``"x"``; other terms as they are."""
    return F.when(key.startswith('"') & key.endswith(_SUFFIX), F.left(key, F.length(key) - F.lit(len(_SUFFIX) - 1))).otherwise(key)


def iri(text: str) -> str:
    return f"<{text}>"


def kind(key: Column) -> Column:
    """Rank of the term's kind; NULL is 0."""
    return (
        F.when(key.isNull(), 0)
        .when(key.startswith("<<"), QUOTED)
        .when(key.startswith("<"), IRI)
        .when(key.startswith("_:"), BLANK)
        .when(key.startswith('"') & key.endswith('"'), STRING)
        .when(key.startswith('"') & key.endswith(">"), TYPED)
        .when(key.startswith('"'), LANG)
        .when(key.rlike(r"^[+-]?\d+$"), INTEGER)
        .when(key.rlike(r"^[+-]?\d*\.\d+$"), DECIMAL)
        .otherwise(DOUBLE)
    )


def is_literal(key: Column) -> Column:
    return ~key.startswith("<") & ~key.startswith("_:")


def literal_text(key: Column) -> Column:
    r"""Text of a literal without quotes, language and datatype, ``\"`` unescaped; NULL for other terms."""
    body = F.regexp_extract(key, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    return F.when(key.startswith('"'), F.replace(body, F.lit('\\"'), F.lit('"'))).when(is_literal(key), key)


# -- parts and sort keys in Python ------------------------------------------------------------------------------

_TYPED = re.compile(r'"(.*)"\^\^<([^>]*)>\Z', re.S)
_LANG = re.compile(r'"(.*)"@([A-Za-z0-9-]+)\Z', re.S)


def kind_of(key: str | None) -> int:
    if key is None:
        return 0
    if key.startswith("<<"):
        return QUOTED
    if key.startswith("<"):
        return IRI
    if key.startswith("_:"):
        return BLANK
    if key.startswith('"'):
        return STRING if key.endswith('"') else TYPED if key.endswith(">") else LANG
    if re.fullmatch(r"[+-]?\d+", key):
        return INTEGER
    return DECIMAL if re.fullmatch(r"[+-]?\d*\.\d+", key) else DOUBLE


def split_quoted(key: str) -> tuple[str, str, str]:
    """The three component keys of ``<< s p o >>``."""
    inner, parts, i = key[2:-2].strip(), [], 0
    while i < len(inner):
        j = term_end(inner, i)
        parts.append(inner[i:j])
        i = j
        while i < len(inner) and inner[i] in " \t":
            i += 1
    if len(parts) != 3:
        raise ValueError(f"not a quoted triple: {key}")
    return parts[0], parts[1], parts[2]


def term_end(text: str, i: int) -> int:
    """Index behind the canonical term that begins at ``i``."""
    if text.startswith("<<", i):
        depth, j = 0, i
        while j < len(text):
            if text.startswith("<<", j):
                depth, j = depth + 1, j + 2
            elif text.startswith(">>", j):
                depth, j = depth - 1, j + 2
                if not depth:
                    return j
            elif text[j] in '"<':
                j = term_end(text, j)
            else:
                j += 1
        raise ValueError("quoted triple not closed")
    if text[i] == "<":
        return text.index(">", i) + 1
    if text[i] == '"':
        j = i + 1
        while text[j] != '"':
            j += 2 if text[j] == "\\" else 1
        j += 1
        if text.startswith("^^", j):
            return text.index(">", j) + 1
    else:
        j = i
    while j < len(text) and text[j] not in " \t":
        j += 1
    return j


def _bytes(text: str) -> bytes:
    return text.encode().replace(b"\0", b"\0\xff") + b"\0\0"


def _magnitude(digits: str) -> bytes:
    """Digits without leading zeros behind their number, so that unsigned order of the bytes is the order of values."""
    return struct.pack(">Q", len(digits)) + digits.encode()


def _signed(negative: bool, whole: str, fraction: str = "") -> bytes:
    """A number of any length: sign, digits before the point behind their number, digits behind it; complemented below zero."""
    whole, fraction = whole.lstrip("0"), fraction.rstrip("0")
    body = _magnitude(whole) + fraction.encode() + b"\0"
    if negative and (whole or fraction):
        return b"\0" + bytes(255 - x for x in body)
    return b"\1" + body


def sort_key(key: str | None) -> bytes | None:
    """Bytes whose unsigned order is the total order of terms: kind, then value, quoted triples component by component.

    Integers and decimals are ordered exactly at any number of digits.  Text that is no term follows all terms, in the
    order of its code points.
    """
    if key is None:
        return None
    try:
        return _term_key(key)
    except (ValueError, TypeError, IndexError):
        return bytes([TYPED + 1]) + _bytes(key)


def _term_key(key: str) -> bytes:
    k = kind_of(key)
    head = bytes([k])
    if k == QUOTED:
        return head + b"".join(_term_key(x) for x in split_quoted(key))
    if k == IRI:
        return head + _bytes(key[1:-1])
    if k == BLANK:
        scope, _, number = key[2:].rpartition("/")
        if number.isascii() and number.isdigit():
            return head + _bytes(scope) + _magnitude(number.lstrip("0")) + _bytes(number)
        return head + _bytes(scope) + b"\xff" * 8 + _bytes(number)
    if k == STRING:
        return head + _bytes(key[1:-1])
    if k == LANG:
        m = _LANG.match(key)
        return head + _bytes(m[1]) + _bytes(m[2])
    if k == TYPED:
        m = _TYPED.match(key)
        return head + _bytes(m[1]) + _bytes(m[2])
    if k in (INTEGER, DECIMAL):
        whole, _, fraction = key.lstrip("+-").partition(".")
        if not (whole + fraction).isascii():
            whole, fraction = (re.sub(r"\d", lambda m: str(int(m[0])), x) for x in (whole, fraction))
        return head + _signed(key.startswith("-"), whole, fraction) + _bytes(key)
    bits = struct.unpack(">Q", struct.pack(">d", float(key)))[0]
    return head + struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63)) + _bytes(key)


@F.pandas_udf(BinaryType())
def sort_key_udf(keys: pd.Series) -> pd.Series:
    """``sort_key`` by Arrow batch, each distinct term once."""
    made = {k: sort_key(k) for k in keys.dropna().unique()}
    return keys.map(made)
