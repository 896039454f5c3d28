"""A plain scanner of N-Triples-star lines, character by character: what the structural index is compared with."""

from __future__ import annotations

import re

from tripleloom.functions.literals import canonical
from tripleloom.functions.terms import RDF_TYPE, XSD
from tripleloom.sources.lines import ESCAPES, IRI_BODY, LABEL, NAME, NUMBER, SPACE, TAG, BASE_LINE, PREFIX_LINE, valid_typed

_WORD, _LETTER = r"\w", r"[^\W\d_]"
_IRI, _ESCAPES, _TAG, _NUMBER, _LABEL, _NAME = (re.compile(x.replace(r"[\p{L}\p{Nl}\p{No}]", _LETTER).replace(r"\p{L}\p{N}_", _WORD), re.S) for x in (IRI_BODY, ESCAPES, TAG, NUMBER, LABEL, NAME))
_DIRECTIVE = re.compile(f"{PREFIX_LINE}|{BASE_LINE}")


class _Bad(Exception):
    pass


def _scan(line: str) -> list[tuple]:
    """Tokens of a line up to its comment: ('iri', body), ('string', body, tag, datatype), ('word', text), '<<', '>>', '.'."""
    tokens, i, n, depth = [], 0, len(line), 0
    while i < n:
        c = line[i]
        if c in SPACE:
            i += 1
        elif c == "#":
            break
        elif line.startswith("<<", i):
            tokens.append(("<<",))
            depth, i = depth + 1, i + 2
        elif line.startswith(">>", i) and depth:
            tokens.append((">>",))
            depth, i = depth - 1, i + 2
        elif c == ">":
            raise _Bad("quoting")
        elif c == "<":
            body, i = _iri_end(line, i)
            tokens.append(("iri", body))
        elif c == '"':
            j = i + 1
            while j < n and line[j] != '"':
                j += 2 if line[j] == "\\" else 1
            if j >= n:
                raise _Bad("quoting")
            body, j, tag, datatype = line[i + 1 : j], j + 1, None, None
            if line.startswith("^^<", j) and not line.startswith("^^<<", j):
                datatype, j = _iri_end(line, j + 2)
            elif j < n and line[j] == "@":
                k = j
                while k < n and line[k] not in SPACE + '<>"#':
                    k += 1
                tag = line[j:k]
                if tag.endswith("."):
                    tag, k = tag[:-1], k - 1
                j = k
            elif j < n and line[j] not in SPACE + ".#" and not (depth and line.startswith(">>", j)):
                raise _Bad("quoting")
            tokens.append(("string", body, tag, datatype))
            i = j
        else:
            j = i
            while j < n and line[j] not in SPACE + '<>"#':
                j += 1
            word = line[i:j]
            dots = len(word) - len(word.rstrip(".")) if word.endswith(".") else 0
            if len(word) > dots:
                tokens.append(("word", word[: len(word) - dots]))
            tokens += [(".",)] * dots
            i = j
    if depth:
        raise _Bad("quoting")
    return tokens


def _iri_end(line: str, i: int) -> tuple[str, int]:
    j = i + 1
    while j < len(line) and line[j] not in "<>":
        j += 1
    if j == len(line) or line[j] == "<":
        raise _Bad("quoting")
    return line[i + 1 : j], j + 1


def _group(tokens: list[tuple]) -> list:
    """Three terms, quoted triples as nested lists; raises ``columns``."""
    stack: list[list] = [[]]
    for at, t in enumerate(tokens):
        if t[0] == "<<":
            stack.append([])
        elif t[0] == ">>":
            done = stack.pop()
            if len(done) != 3:
                raise _Bad("columns")
            stack[-1].append(done)
        elif t[0] == ".":
            if len(stack) > 1 or len(stack[0]) != 3 or at != len(tokens) - 1:
                raise _Bad("columns")
            return stack[0]
        else:
            stack[-1].append(t)
    raise _Bad("columns")


def _term(t, place: int, prefixes: dict[str, str] | None) -> str:
    """Canonical key of a term at place 0 (subject), 1 or 2; raises ``value``."""
    if isinstance(t, list):
        if place == 1:
            raise _Bad("value")
        return f"<< {' '.join(_term(x, k, prefixes) for k, x in enumerate(t))} >>"
    if t[0] == "iri":
        if not _IRI.fullmatch(t[1]):
            raise _Bad("value")
        return f"<{t[1]}>"
    if t[0] == "string":
        _, body, tag, datatype = t
        if place != 2 or not _ESCAPES.fullmatch(body) or tag is not None and not _TAG.fullmatch(tag) or datatype is not None and not (_IRI.fullmatch(datatype) and valid_typed(body, datatype)):
            raise _Bad("value")
        return f'"{canonical(body)}"' + (tag or "") + (f"^^<{datatype}>" if datatype is not None and datatype != XSD + "string" else "")
    word = t[1]
    if word == "a" and place == 1:
        return RDF_TYPE
    if _NUMBER.fullmatch(word):
        if place != 2:
            raise _Bad("value")
        return word
    if word.startswith("_:"):
        if place == 1 or not _LABEL.fullmatch(word):
            raise _Bad("value")
        return word
    if not _NAME.fullmatch(word):
        raise _Bad("value")
    prefix, _, local = word.partition(":")
    if prefixes is None or prefix not in prefixes:
        return word
    return f"<{prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"


def judge(line: str | None, filename: str | None, prefixes: dict[str, str] | None = None) -> tuple[str | None, tuple[str, str, str] | None]:
    """(reason, None) of a failing line, (None, triple) of a valid one, (None, None) of one that is neither."""
    bare = (line or "").strip(SPACE)
    if not bare or bare[0] == "#":
        return None, None
    if filename is None or not filename.endswith(("ttl", "nt")):
        return "file", None
    if _DIRECTIVE.match(line):
        return None, None
    try:
        terms = _group(_scan(line))
        return None, tuple(_term(t, k, prefixes) for k, t in enumerate(terms))
    except _Bad as bad:
        return str(bad), None
