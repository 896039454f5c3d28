r"""Lines of N-Triples-star files (in ``.ttl`` files with prefixed names): valid triples and rejects with reasons.

Structural indexing: over the bytes of a whole Arrow batch, numpy finds quotes that no backslash escapes, the prefix
parity of the quotes says what lies inside strings, bracket depth what lies inside IRIs, and from both come comment
starts, token bounds and statement ends.  Counts and type checks of these tokens accept most lines.  Of the others (a few
percent: damaged lines, quoted triples, quotes inside IRIs) the index is refined: for every byte the next delimiters give
the token that would begin there and the token behind it, and jumping along these by doubling marks the true tokens of
all lines at once.  Open brackets and quotes give ``quoting``, the depth of quoted triples and counts of terms
``columns``, type checks of the tokens ``value``, and what passes all is valid.

Reasons, the first that applies: ``file``, ``quoting``, ``columns``, ``value``.  Blank lines, comments and prefix lines
are neither valid nor failing.  Defined cases: a NULL line is blank; a NULL file name fails with ``file``; an empty
table gives nothing; repeated lines are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import canonical
from ..functions.terms import RDF_TYPE, XSD
from ..runtime import broadcast_if_small

SPACE = " \t\r"
# Characters and forms that N-Triples allows.
IRI_BODY = r"(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*"
ESCAPES = r"(?:[^\\]|\\[tbnrf\"'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*"
TAG = r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?[eE][+-]?[0-9]+|\.[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)"
LABEL = r"_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-·]*[\p{L}\p{N}_\-·])?"
NAME = r"(?:[\p{L}\p{Nl}\p{No}](?:[\p{L}\p{N}_.\-·]*[\p{L}\p{N}_\-·])?)?:(?:(?:[\p{L}\p{N}_:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])(?:(?:[\p{L}\p{N}_:.\-·]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])*(?:[\p{L}\p{N}_:\-·]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-]))?)?"
PREFIX_LINE = r"^[ \t\r]*@?[Pp][Rr][Ee][Ff][Ii][Xx][ \t]+([^ \t:<>]*):[ \t]*<([^<>\" ]*)>[ \t\r]*\.?[ \t\r]*(?:#.*)?$"
BASE_LINE = r"^[ \t\r]*@?[Bb][Aa][Ss][Ee][ \t]+<[^<>\" ]*>[ \t\r]*\.?[ \t\r]*(?:#.*)?$"

DIRECTIVE = f"(?:{PREFIX_LINE})|(?:{BASE_LINE})"
_PLAIN = f"^^<{XSD}string>"
_ZONE = r"(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_FORMS = {
    f"{XSD}integer": re.compile(r"[+-]?[0-9]+"),
    f"{XSD}decimal": re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"),
    f"{XSD}boolean": re.compile(r"true|false|1|0"),
    f"{XSD}date": re.compile(r"-?(?:[1-9][0-9]{4,}|[0-9]{4})-([0-9]{2})-([0-9]{2})" + _ZONE),
    f"{XSD}gYear": re.compile(r"-?(?:[1-9][0-9]{4,}|[0-9]{4})" + _ZONE),
}


def valid_typed(text: str, datatype: str) -> bool:
    """Whether ``text`` is a lexical form of ``datatype``; types without a known form accept all."""
    form = _FORMS.get(datatype)
    if form is None:
        return True
    m = form.fullmatch(text)
    if not m or not datatype.endswith("#date"):
        return bool(m)
    year = int(text[: text.index("-", 1)])
    try:  # the calendar repeats every 400 years
        datetime.date(year % 400 + 400, int(m[1]), int(m[2]))
    except ValueError:
        return False
    return True


# -- structural index -------------------------------------------------------------------------------------------


def _line_starts(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lines and their offsets (one more than lines)."""
    lines = lines.cast(pa.large_string())
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, np.uint8)
    return text, (at - at[0]) if len(at) else np.zeros(1, np.int64)


class StructuralIndex:
    """Where strings, IRIs, comments and tokens lie in a batch of lines."""

    def __init__(self, lines: pa.Array):
        b, at = _line_starts(lines)
        self.bytes, self.at, size, count = b, at, len(b), len(at) - 1
        place = np.arange(size)
        line = np.repeat(np.arange(count), np.diff(at))
        begin = at[:-1][line] if size else place

        def run(values: np.ndarray) -> np.ndarray:
            """Running sum inside each line, each place included."""
            total = np.concatenate([[0], np.cumsum(values)])
            return total[1:] - total[begin] if size else total[1:]

        back = b == 92
        last_other = np.maximum.accumulate(np.where(back, begin - 1, place)) if size else place
        behind = np.concatenate([[0], (place - np.maximum(last_other, begin - 1))[:-1]]) if size else place  # backslashes before a place
        behind[at[:-1][at[:-1] < size]] = 0
        quote = (b == 34) & (behind % 2 == 0)
        inside = (run(quote) - quote) % 2 == 1  # before this byte an odd number of quotes: in a string, or its closing quote
        text = inside | quote
        depth = run(((b == 60) & ~text).astype(np.int64) - ((b == 62) & ~text))
        iri = (depth > 0) | ((b == 62) & ~text)
        mark = (b == 35) & ~text & ~iri
        live = run(mark) == 0
        gap = ((b == 32) | (b == 9) | (b == 13)) & ~text & ~iri | ~live
        word = ~gap
        start = word.copy()
        start[1:] &= gap[:-1] | (line[1:] != line[:-1])
        end = word.copy()
        end[:-1] &= gap[1:] | (line[1:] != line[:-1])
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.token_line = line[self.starts] if size else self.starts
        self.tokens = np.bincount(self.token_line, minlength=count)
        totals = np.concatenate([[0], np.cumsum(quote & live)])
        self.even = (totals[at[1:]] - totals[at[:-1]]) % 2 == 0
        balance = np.concatenate([[0], np.cumsum(np.where(live & ~text, (b == 60).astype(np.int64) - (b == 62), 0))])
        self.balanced = balance[at[1:]] == balance[at[:-1]]

    def plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines of three tokens and a dot with closed quotes and brackets; starts and ends of their tokens (n x 3)."""
        first = np.concatenate([[0], np.cumsum(self.tokens)])[:-1]
        good = self.even & self.balanced & ((self.tokens == 3) | (self.tokens == 4))
        rows = np.flatnonzero(good)
        if not len(rows):
            return rows, np.empty((0, 3), np.int64), np.empty((0, 3), np.int64)
        at = first[rows]
        close = self.ends[at + self.tokens[rows] - 1]
        dotted = self.bytes[close - 1] == 46
        alone = (self.tokens[rows] == 3) | (self.ends[at + self.tokens[rows] - 1] - self.starts[at + self.tokens[rows] - 1] == 1)
        keep = dotted & alone
        rows, at = rows[keep], at[keep]
        starts = np.stack([self.starts[at + k] for k in range(3)], 1)
        ends = np.stack([self.ends[at + k] for k in range(3)], 1)
        ends[:, 2] -= self.tokens[rows] == 3  # the dot that touches the object
        keep = ends[:, 2] > starts[:, 2]
        return rows[keep], starts[keep], ends[keep]


_R_IRI = r'<[^\x00-\x20<>"{}|^`\\]*>'
_R_NAME = r"[A-Za-z][A-Za-z0-9]*:[A-Za-z0-9_]+"
_R_LABEL = r"_:[A-Za-z0-9]+"
_R_BODY = r'"(?:[^"\\]|\\[tbnrf"\'\\])*"'
_R_OBJECT = rf"^(?:{_R_IRI}|{_R_NAME}|{_R_LABEL}|{_R_BODY}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?|[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_R_TYPED = rf"^{_R_BODY}\^\^{_R_IRI}$"


def index_lines(lines: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows that the structural index accepts, and their three terms as they stand in the lines."""
    found = StructuralIndex(lines)
    rows, starts, ends = found.plain()
    s, p, o = (_cut(found.bytes, starts[:, k], ends[:, k]) for k in range(3))

    def matches(a: pa.Array, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False)

    ok = matches(s, rf"^(?:{_R_IRI}|{_R_NAME}|{_R_LABEL})$") & matches(p, rf"^(?:{_R_IRI}|{_R_NAME}|a)$")
    typed = matches(o, _R_TYPED)
    ok &= matches(o, _R_OBJECT) | typed
    check = np.flatnonzero(typed & ok)
    if len(check):
        seen = pc.dictionary_encode(o.take(pa.array(check)))
        good = np.array([valid_typed(*x[1:-1].rsplit('"^^<', 1)) for x in seen.dictionary.to_pylist()], bool)
        ok[check] = good[seen.indices.to_numpy()]
    keep = pa.array(np.flatnonzero(ok))
    return rows[ok], [a.take(keep) for a in (s, p, o)]


OPEN, CLOSE, TERM_IRI, TERM_STRING, TERM_WORD, DOT, NOTE, BROKEN = range(8)
REASONS = np.array(["", "file", "quoting", "columns", "value"], object)
FILE, QUOTING, COLUMNS, VALUE = 1, 2, 3, 4


def _next(mask: np.ndarray) -> np.ndarray:
    """For each place (and the one behind the last) the first place from there on where ``mask`` holds; else the size."""
    size = len(mask)
    at = np.where(mask, np.arange(size), size)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], size) if size else np.zeros(1, np.int64)


class TokenChains:
    """The tokens of lines of any form, and the first reason why a line fails.

    ``kind``, ``start``, ``end``, ``line`` describe tokens in order; ``close`` is the place of a string's closing quote.
    ``fails`` has a code of ``REASONS`` for each line.  ``place`` (0, 1, 2) is a term's place in its triple, ``top`` the
    place in the statement, both -1 where it does not apply.
    """

    def __init__(self, lines: pa.Array):
        b, at = _line_starts(lines)
        size, count = len(b), len(at) - 1
        self.fails = np.zeros(count, np.int8)
        self._tokens(b, at, size, count)
        self._nest(count)
        self._check(b)

    def _tokens(self, b: np.ndarray, at: np.ndarray, size: int, count: int) -> None:
        place = np.arange(size)
        row = np.repeat(np.arange(count), np.diff(at))
        stop = at[1:][row] if size else place
        ahead = np.append(b, np.zeros(5, np.uint8))

        def byte(where: np.ndarray) -> np.ndarray:
            """The byte at each place; 0 beyond the line's end."""
            return np.where(where < stop, ahead[np.minimum(where, size)], 0)

        blank = (b == 32) | (b == 9) | (b == 13)
        last_other = np.maximum.accumulate(np.where(b == 92, at[:-1][row] - 1 if size else place, place)) if size else place
        behind = np.concatenate([[0], (place - last_other)[:-1]]) if size else place
        behind[at[:-1][at[:-1] < size]] = 0
        closer, bracket, edge, solid = _next((b == 34) & (behind % 2 == 0)), _next((b == 60) | (b == 62)), _next(blank | (b == 60) | (b == 62) | (b == 34) | (b == 35)), _next(~blank)
        one = byte(place + 1)
        kind = np.full(size, TERM_WORD, np.int8)
        end = np.minimum(edge[:-1], stop) if size else place
        # IRIs, quoted triples
        shut = bracket[np.minimum(place + 1, size)]
        iri = (b == 60) & (one != 60)
        kind[iri] = np.where((shut < stop) & (byte(shut) == 62), TERM_IRI, BROKEN)[iri]
        end = np.where(iri, shut + 1, end)
        double = ((b == 60) & (one == 60)) | ((b == 62) & (one == 62))
        kind[double] = np.where(b[double] == 60, OPEN, CLOSE)
        end = np.where(double, place + 2, end)
        kind[(b == 62) & (one != 62)] = BROKEN
        kind[b == 35] = NOTE
        # strings and what follows the closing quote
        close = closer[np.minimum(place + 1, size)]
        after = close + 1
        x0, x1, x2, x3 = (byte(after + k) for k in range(4))
        typed = (x0 == 94) & (x1 == 94) & (x2 == 60) & (x3 != 60)
        typed_shut = bracket[np.minimum(after + 3, size)]
        tagged = x0 == 64
        tag_end = np.minimum(edge[np.minimum(after, size)], stop)
        tag_end -= byte(tag_end - 1) == 46
        alone = (x0 == 32) | (x0 == 9) | (x0 == 13) | (x0 == 46) | (x0 == 35) | ((x0 == 62) & (x1 == 62))
        sound = (close < stop) & np.where(typed, (typed_shut < stop) & (byte(typed_shut) == 62), tagged | alone | (after >= stop))
        string = b == 34
        kind[string] = np.where(sound, TERM_STRING, BROKEN)[string]
        end = np.where(string, np.where(typed, typed_shut + 1, np.where(tagged, tag_end, after)), end)
        # where the next token begins; `size` where a line's chain ends
        after = solid[np.minimum(end, size)]
        after = np.append(np.where((after < stop) & (kind != NOTE) & (kind != BROKEN), after, size), size)
        first = solid[at[:-1]]
        reached = np.zeros(size + 1, bool)
        reached[first[first < at[1:]]] = True
        while True:  # tokens reached in twice as many steps
            new = after[np.flatnonzero(reached[:size])]
            new = new[new < size]
            if not len(new):
                break
            reached[new] = True
            after = after[after]
        start = np.flatnonzero(reached[:size])
        kind, end, close, line = kind[start], end[start], close[start], row[start]
        self.fails[line[kind == BROKEN]] = QUOTING
        # the dots at the end of a word are tokens of their own
        last_letter = np.maximum.accumulate(np.where(b != 46, place, -1)) if size else place
        word = kind == TERM_WORD
        stem = np.where(word, np.maximum(last_letter[np.clip(end - 1, 0, size - 1)], start - 1) + 1, end) if size else end
        dotted = np.flatnonzero(stem < end)
        keep = np.flatnonzero((kind != NOTE) & (kind != BROKEN) & (stem > start))
        join = lambda a, d: np.concatenate([a[keep], d])
        parts = [join(kind, np.full(len(dotted), DOT, np.int8)), join(start, stem[dotted]), join(stem, end[dotted]), join(close, close[dotted]), join(line, line[dotted])]
        order = np.argsort(parts[1], kind="stable")
        self.kind, self.start, self.end, self.close, self.line = (p[order] for p in parts)

    def _nest(self, count: int) -> None:
        """Depths and places; finds what is not balanced or has not three terms and one dot at its end."""
        kind, line, n = self.kind, self.line, len(self.kind)
        step = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
        total = np.concatenate([[0], np.cumsum(step)])
        head = np.searchsorted(line, np.arange(count))
        tail = np.searchsorted(line, np.arange(count), "right")
        depth = total[1:] - total[head][line]
        self.fails[line[depth < 0]] = QUOTING
        self.fails[total[tail] != total[head]] = QUOTING
        # dots
        dots = np.bincount(line[kind == DOT], (self.end - self.start)[kind == DOT], count)
        ends = np.zeros(count, bool)
        some = tail > head
        ends[some] = (kind[tail[some] - 1] == DOT) & (depth[tail[some] - 1] == 0)
        short = (dots != 1) | ~ends
        # groups of terms: each line at level 0, each quoted triple one level below the one it stands in
        term = (kind != CLOSE) & (kind != DOT)
        opened = np.flatnonzero(kind == OPEN)
        child = np.flatnonzero(term)
        lines = np.concatenate([np.arange(count), line[opened], line[child]])
        levels = np.concatenate([np.zeros(count, np.int64), depth[opened], depth[child] - (kind[child] == OPEN)])
        places = np.concatenate([np.full(count, -1), opened, child])
        begins = np.arange(len(lines)) < count + len(opened)
        order = np.lexsort((places, np.maximum(levels, 0), lines))
        begins = begins[order]
        group = np.cumsum(begins) - 1
        sizes = np.bincount(group[~begins], minlength=group[-1] + 1 if len(group) else 0)
        short[lines[order][begins][sizes != 3]] = True
        self.fails[short & (self.fails == 0)] = COLUMNS
        self.place, self.top = np.full(n, -1), np.full(n, -1)
        inner = order[~begins]
        self.place[places[inner]] = np.flatnonzero(~begins) - np.flatnonzero(begins)[group[~begins]] - 1
        outer = np.zeros(n, np.int64)
        outer[child] = (depth[child] - (kind[child] == OPEN)) == 0
        run = np.concatenate([[0], np.cumsum(outer)])
        self.top = run[1:] - run[head][line] - 1

    def _check(self, b: np.ndarray) -> None:
        """Type checks of the terms of lines that no other reason has failed."""
        live = self.fails[self.line] == 0
        self.text = [None, None]  # bodies and suffixes of the tokens below
        at = np.flatnonzero(live & (self.kind != CLOSE) & (self.kind != DOT) & (self.kind != OPEN))
        bad = np.flatnonzero(live & (self.kind == OPEN) & (self.place == 1))
        kind, place = self.kind[at], self.place[at]
        string = kind == TERM_STRING
        body = _cut(b, self.start[at], np.where(string, self.close[at] + 1, self.end[at]))
        suffix = _cut(b, np.where(string, self.close[at] + 1, self.end[at]), self.end[at])
        like = lambda a, pattern: pc.match_substring_regex(a, f"(?s)^(?:{pattern})$").to_numpy(zero_copy_only=False)
        iri = like(body, f"<{IRI_BODY}>")
        kind_ok = np.where(kind == TERM_IRI, iri, (place == 2) & like(body, f'"{ESCAPES}"') & like(suffix, rf"|{TAG}|\^\^<{IRI_BODY}>"))
        number, verb = like(body, NUMBER), like(body, "a") & (place == 1)
        blank = pc.starts_with(body, "_:").to_numpy(zero_copy_only=False)
        word_ok = verb | np.where(number, place == 2, np.where(blank, (place != 1) & like(body, LABEL), like(body, NAME)))
        ok = np.where(kind == TERM_WORD, word_ok, kind_ok)
        known = np.flatnonzero(ok & string & pc.is_in(suffix, pa.array([f"^^<{d}>" for d in _FORMS], pa.large_string())).to_numpy(zero_copy_only=False))
        if len(known):
            both = pc.dictionary_encode(pc.binary_join_element_wise(body.take(pa.array(known)), suffix.take(pa.array(known)), pa.scalar("", pa.large_string())))
            good = np.array([valid_typed(*x[1:-1].rsplit('"^^<', 1)) for x in both.dictionary.to_pylist()], bool)
            ok[known] = good[both.indices.to_numpy()]
        self.fails[self.line[np.concatenate([at[~ok], bad])]] = VALUE
        self.at, self.body, self.suffix = at, body, suffix

    def triples(self, maps: list[dict]) -> tuple[np.ndarray, list[list[str]]]:
        """Valid lines and the canonical keys of their three terms; ``maps`` has each line's prefixes."""
        fine = self.fails == 0
        keep = np.flatnonzero(fine[self.line[self.at]])
        at = self.at[keep]
        whole = pc.binary_join_element_wise(self.body.take(pa.array(keep)), self.suffix.take(pa.array(keep)), pa.scalar("", pa.large_string()))
        pieces = {int(i): t for i, t in zip(at, _expand(whole, self.line[at], maps))}
        rows = np.flatnonzero(fine)
        keys = {(int(r), k): [] for r in rows for k in range(3)}
        for i in np.flatnonzero(fine[self.line] & (self.kind != DOT)):
            keys[int(self.line[i]), int(self.top[i])].append("<<" if self.kind[i] == OPEN else ">>" if self.kind[i] == CLOSE else pieces[int(i)])
        return rows, [[" ".join(keys[int(r), k]) for r in rows] for k in range(3)]


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings, copied once."""
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(starts - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[take])])


def _expand(terms: pa.Array, line: np.ndarray, maps: list[dict]) -> list[str]:
    """Canonical keys of terms as they stand in the lines; ``a`` stands for rdf:type."""
    out = terms.to_pylist()
    for k, t in enumerate(out):
        if t == "a":
            out[k] = RDF_TYPE
        elif t[0] == '"':
            end = t.rindex('"')
            rest = t[end + 1 :]
            out[k] = f'"{canonical(t[1:end])}"{"" if rest == _PLAIN else rest}'
        elif t[0] not in "<_+-.0123456789":
            prefix, _, local = t.partition(":")
            if prefix in maps[line[k]]:
                out[k] = f"<{maps[line[k]][prefix]}{_LOCAL.sub(r'\1', local)}>"
    return out


_LOCAL = re.compile(r"\\(.)", re.S)


def judge_batch(lines: pa.Array, names: pa.Array, maps: list[dict] | None = None) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """For each line its code in ``REASONS`` (0: none); with ``maps`` (prefixes by line) also the valid rows and terms."""
    lines = pc.fill_null(lines, "")
    flags = lambda a: a.to_numpy(zero_copy_only=False)
    named = flags(pc.fill_null(pc.or_(pc.ends_with(names, "ttl"), pc.ends_with(names, "nt")), False))
    rows, terms = index_lines(lines)
    good = named[rows]
    rest = np.ones(len(lines), bool)
    rest[rows[good]] = False
    other = np.flatnonzero(rest)
    left = lines.take(pa.array(other))
    bare = pc.utf8_ltrim(left, SPACE)
    said = flags(pc.and_(pc.not_equal(bare, ""), pc.invert(pc.starts_with(bare, "#"))))
    codes = np.zeros(len(lines), np.int8)
    codes[other[said & ~named[other]]] = FILE
    said &= named[other]
    said[said] = ~flags(pc.match_substring_regex(left.filter(pa.array(said)), DIRECTIVE))
    other = other[said]
    chains = TokenChains(left.filter(pa.array(said)))
    codes[other] = chains.fails
    if maps is None:
        return codes, rows[good], []
    more, keys = chains.triples([maps[i] for i in other])
    first = [_expand(t.filter(pa.array(good)), rows[good], maps) for t in terms]
    return codes, np.concatenate([rows[good], other[more]]), [a + b for a, b in zip(first, keys)]


def _judge_batches(triples: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("line_id")
            codes, rows, keys = judge_batch(b.column("line"), b.column("filename"), [dict(m or ()) for m in b.column("prefixes").to_pylist()] if triples else None)
            if triples:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *[pa.array(k, pa.string()) for k in keys]], names=["line_id", "s", "p", "o"])
            else:
                bad = np.flatnonzero(codes)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(bad)), pa.array(REASONS[codes[bad]], pa.string())], names=["line_id", "reason"])

    return run


def rejects(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the failing lines of (line_id, filename, line)."""
    return lines.select("line_id", "filename", "line").mapInArrow(_judge_batches(False), "line_id bigint, reason string")


def prefix_maps(lines: DataFrame) -> DataFrame:
    """(filename, prefixes): the prefixes each file declares; of several declarations of one the first line's counts."""
    found = lines.where(F.col("line").rlike(PREFIX_LINE) & F.col("filename").isNotNull())
    found = found.select("filename", F.regexp_extract("line", PREFIX_LINE, 1).alias("prefix"), F.regexp_extract("line", PREFIX_LINE, 2).alias("iri"), "line_no")
    one = found.groupBy("filename", "prefix").agg(F.min_by("iri", "line_no").alias("iri"))
    return one.groupBy("filename").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "iri"))).alias("prefixes"))


def valid_triples(lines: DataFrame) -> DataFrame:
    """(line_id, s, p, o) of the valid lines of (line_id, filename, line_no, line); prefixed names become IRIs where
    their file declares the prefix, and stay as they are otherwise."""
    rows = lines.select("line_id", "filename", "line").join(broadcast_if_small(prefix_maps(lines)), "filename", "left")
    return rows.mapInArrow(_judge_batches(True), "line_id bigint, s string, p string, o string")


def judge_lines(lines: DataFrame) -> DataFrame:
    """(filename, line, s, p, o, reason) of every line of (line_id, filename, line_no, line) that is valid or fails."""
    rows = lines.select("line_id", "filename", "line").join(broadcast_if_small(prefix_maps(lines)), "filename", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, good, keys = judge_batch(b.column("line"), b.column("filename"), [dict(m or ()) for m in b.column("prefixes").to_pylist()])
            bad = np.flatnonzero(codes)
            at, none = pa.array(np.concatenate([good, bad])), [None] * len(bad)
            reason = pa.array([None] * len(good) + list(REASONS[codes[bad]]), pa.string())
            columns = [b.column("filename").take(at), b.column("line").take(at), *[pa.array(k + none, pa.string()) for k in keys], reason]
            yield pa.RecordBatch.from_arrays(columns, names=["filename", "line", "s", "p", "o", "reason"])

    return rows.mapInArrow(run, "filename string, line string, s string, p string, o string, reason string")
