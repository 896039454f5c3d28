"""Byte-level BPE as a lazily determinised transducer.

Which token ends at a place of a word depends only on a bounded window before it: the longest suffix read so far that
some token begins with, and the tokens that end inside that suffix.  That window is the transducer's state.  Reading a
byte, the one token that can end there is the one whose boundary with its predecessor no merge crosses.  States and
transitions are made when first needed and kept; a transition emits the token that ends at its byte, and a token is
settled as soon as all windows lead back to it, which is after at most one window (the longest token).

Merges never cross the boundary between neighbouring tokens ``a`` and ``b`` if no piece on the right edge of ``a`` and
piece on the left edge of ``b``, alive at the same time, form a merge.  Merges are applied in order of rank and a merged
piece has a higher rank than its parts, so a piece is alive from its own rank to that of the piece that swallows it.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: States and words kept by one worker before the tables are begun anew (nothing is lost, only made again).
MOST_STATES, MOST_WORDS = 150_000, 150_000
#: Bytes of text for which arrays are made at once.
PIECE_BYTES = 1 << 20

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# The code points with the property White_Space.
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# What may follow an apostrophe as one word of its own.
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


@dataclass(frozen=True)
class Vocabulary:
    """``tokens[i]`` are the bytes of id i; ``merges`` maps pairs of ids to the merged id."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    classes: bytes

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a tokenizers JSON file of a byte-level BPE whose pre-tokenizer is the byte-level pattern."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the file writes byte b as a printable character: itself, or the next unused one from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ids = model["vocab"]
        tokens = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            tokens[i] = bytes(of[c] for c in text)
        left, right = [-1] * len(tokens), [-1] * len(tokens)
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            i = ids[a + b]
            if left[i] < 0:
                left[i], right[i] = ids[a], ids[b]
        return Vocabulary(tokens, left, right, _classes())


def _classes() -> bytes:
    """The class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    table = bytearray(of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000))
    for c in WHITE:
        table[c] = SPACE
    return bytes(table)


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.left, self.right = vocabulary.tokens, vocabulary.left, vocabulary.right
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.length = [len(t) for t in self.tokens]
        self.merges = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}
        self.begins = {t[:k] for t in self.ids for k in range(1, len(t) + 1)}
        self.classes = np.frombuffer(vocabulary.classes, np.uint8)
        self.words: dict[bytes, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.steps: dict[int, int] = {}  # state * 256 + byte -> state
        self.windows: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self.last: list[int] = [-1]  # token that ends where a state is entered
        self.numbers = {self.windows[0]: 0}
        self.apart: dict[tuple[int, int], bool] = {}

    def boundary(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` next to each other stay apart."""
        known = self.apart.get((a, b))
        if known is None:
            known, x, over = True, a, 1 << 60
            while known and x >= 0:
                y, under = b, 1 << 60
                while y >= 0:
                    m = self.merges.get((x, y))
                    if m is not None and m < over and m <= under:  # of equal merges the leftmost comes first
                        known = False
                        break
                    under, y = y, self.left[y]
                over, x = x, self.right[x]
            self.apart[(a, b)] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """The state after ``byte``, made now."""
        suffix, ends = self.windows[state]
        text = suffix + bytes((byte,))
        token = -1
        for k, before in enumerate(ends):
            t = self.ids.get(text[k:])
            if t is not None and (before < 0 or self.boundary(before, t)):
                token = t
                break
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        keep = 0
        while text[keep:] not in self.begins:
            keep += 1
        window = (text[keep:], (*ends[keep:], token))
        made = self.numbers.get(window)
        if made is None:
            made = self.numbers[window] = len(self.windows)
            self.windows.append(window)
            self.last.append(token)
        self.steps[state << 8 | byte] = made
        return made

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-tokenised word."""
        if len(self.windows) > MOST_STATES:
            self._reset()
        state, steps, last, length, path = 0, self.steps, self.last, self.length, []
        done: list[int] = []
        for byte in word:
            to = steps.get(state << 8 | byte)
            state = self._step(state, byte) if to is None else to
            path.append(last[state])
            if len(path) >= 8192:  # very long words: write what is settled
                settled = self._settled(path, len(self.windows[state][0]))
                done += self._trace(path, settled)
                del path[:settled]
        return (*done, *self._trace(path, len(path)))

    def _trace(self, path: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            t = path[end - 1]
            out.append(t)
            end -= self.length[t]
        out.reverse()
        return out

    def _settled(self, path: list[int], window: int) -> int:
        """The last place that all tokenisations of the window lead back to."""
        ends = set(range(len(path) - window, len(path) + 1))
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.length[path[far - 1]])
        return ends.pop()

    # -- batches of text

    def words_of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens begin; ``starts`` are the offsets at which texts begin."""
        size = len(data)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        if len(at) == size:
            point = data
        else:
            b = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
            first = b[at]
            point = np.where(
                first < 0x80, first,
                np.where(first < 0xE0, (first & 0x1F) << 6 | b[at + 1] & 0x3F,
                np.where(first < 0xF0, (first & 0x0F) << 12 | (b[at + 1] & 0x3F) << 6 | b[at + 2] & 0x3F,
                         (first & 7) << 18 | (b[at + 1] & 0x3F) << 12 | (b[at + 2] & 0x3F) << 6 | b[at + 3] & 0x3F)),
            )
        kind = self.classes[point]
        n = len(at)
        head = np.zeros(n + 1, bool)  # a text begins here (or ends, at n)
        head[np.searchsorted(at, starts)] = True
        head[n] = True
        new = head[:n].copy()
        change = np.zeros(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        new |= change
        white = kind == SPACE
        # the last white character before a word stands alone or, if it is a blank, belongs to the word
        before_word = np.zeros(n, bool)
        before_word[:-1] = white[:-1] & ~white[1:] & ~head[1:n]
        new |= before_word
        joined = np.zeros(n, bool)
        joined[1:] = (before_word & (point == 32))[:-1]
        new &= ~joined
        mark = np.flatnonzero((point == 39) & new)
        if len(mark):
            stop = np.append(np.flatnonzero(head[:n]), n)
            limit = stop[np.searchsorted(stop, mark, "right")]
            text = np.append(point, np.zeros(3, point.dtype))
            long = np.zeros(len(mark), np.int64)
            for c in CONTRACTIONS:
                fits = (mark + len(c) < limit) & (long == 0)
                for k, x in enumerate(c):
                    fits &= text[mark + 1 + k] == x
                long[fits] = len(c)
            mark, long = mark[long > 0], long[long > 0]
            new[mark + 1] = False
            after = mark + 1 + long
            new[after[after < n]] = True
        return at[new]

    def encode_piece(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece one after another, and the number of ids of each text (none is empty)."""
        begins = self.words_of(data, starts)
        offsets = np.append(begins, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        known, found = self.words, []
        for w in words.dictionary.to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = self.encode(w)
                if len(w) < 64:
                    known[w] = ids
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum()))
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        which = words.indices.to_numpy()
        long = size[which]
        end = np.cumsum(long)
        out = flat[np.repeat(base[which] - (end - long), long) + np.arange(end[-1] if len(end) else 0)]
        per_text = np.add.reduceat(long, np.searchsorted(begins, starts)) if len(starts) else np.empty(0, np.int64)
        return out, per_text

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of consecutive texts; the counts over all pieces are one a text, 0 for empty and NULL ones.

        Texts of more than a piece are cut where a white run begins, which is always the begin of a pre-token.
        """
        texts = texts.cast(pa.large_binary())
        _, offsets, buffer = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1].copy() if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
        if texts.null_count:  # a NULL may have bytes
            live = texts.is_valid().to_numpy(zero_copy_only=False)
        else:
            live = np.ones(len(texts), bool)
        size = np.where(live, np.diff(at), 0)
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + size[j] <= PIECE_BYTES):
                total += int(size[j])
                j += 1
            if j == i + 1 and total > PIECE_BYTES:
                ids = [self.encode_piece(p, np.zeros(1, np.int64))[0] for p in _cuts(data[at[i] : at[i + 1]])]
                yield np.concatenate(ids), np.array([sum(map(len, ids))])
            else:
                counts = np.zeros(j - i, np.int64)
                full = np.flatnonzero(size[i:j] > 0)
                if len(full):
                    piece = data[at[i] : at[j]] if live[i:j].all() else np.concatenate([data[at[i + k] : at[i + k + 1]] for k in full])
                    ids, counts[full] = self.encode_piece(piece, np.concatenate([[0], np.cumsum(size[i:j][full])])[:-1])
                else:
                    ids = np.empty(0, np.int32)
                yield ids, counts
            i = j


def _cuts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end before an ASCII white run."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    safe = np.flatnonzero(white[1:] & (data[:-1] < 128) & ~white[:-1]) + 1
    a = 0
    while len(data) - a > PIECE_BYTES:
        k = np.searchsorted(safe, a + PIECE_BYTES)
        b = int(safe[k - 1]) if k and safe[k - 1] > a else int(safe[k]) if k < len(safe) else len(data)
        yield data[a:b]
        a = b
    if a < len(data):
        yield data[a:]


def decode_stream(tokens: list[bytes], ids: Iterable[int], step: int = 4096) -> Iterator[str]:
    """Text of a stream of ids as it becomes complete.

    An incremental UTF-8 state machine keeps the bytes of a character that the last ids left open; bytes that are no
    UTF-8, or a character left open at the end, become U+FFFD.
    """
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    held: list[bytes] = []
    for i in ids:
        held.append(tokens[i])
        if len(held) == step:
            yield machine.decode(b"".join(held))
            held.clear()
    yield machine.decode(b"".join(held), True)
