"""Oversized texts cut at natural boundaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, Sizer, read_vocabulary, sizer

#: Strength of a boundary.
PARAGRAPH, LINE, SENTENCE, WORD, INNER = 4, 3, 2, 1, 0
#: Words whose full stop ends no sentence, beside single letters (fixed values).
ABBREVIATIONS = frozenset("mr mrs ms dr st sgt prof capt lt col gen rev hon jr sr vs etc no nr vol fig ca bzw usw mme mlle sra srta".split())
CLOSERS = "\"')]}”’»›」』）】"
STOPS, WIDE_STOPS = "!?…", "。！？；"
#: A word of more tokens than this gets units of a few characters, so that it can be cut inside.
LONG_WORD, UNIT_CHARS = 16, 4
#: Characters read at once, and cut before the pieces go on.
READ_CHARS = 1_000_000

#: What is remembered of a unit: tokens, characters and marks, packed into one integer.
_LEN, _MARK, _TOKENS, _CHARS = 24, 52, (1 << 24) - 1, (1 << 28) - 1
_WHITE, _LEADS, _BREAKS, _TAIL, _SMALL, _ABBREVIATION = 1, 2, 4, 16, 64, 128
_DOT, _STOP, _WIDE = 1, 2, 3


def unit_marks(unit: str) -> int:
    """Marks of a unit: all white, leading white space, line breaks (0 to 2), kind of stop at its
    end, begins in lower case or with a closing mark, word whose full stop ends no sentence."""
    bare = unit.lstrip()
    if not bare:
        breaks = sum(x != x.splitlines()[0] for x in unit.splitlines(True))
        return _WHITE | _LEADS | min(breaks, 2) * _BREAKS
    marks = _LEADS if unit[0].isspace() else 0
    tail = bare.rstrip(CLOSERS)
    if tail == ".":
        marks |= _DOT * _TAIL
    elif tail:
        marks |= (_WIDE if tail[-1] in WIDE_STOPS else _STOP if tail[-1] in STOPS or tail[-2:] == ".." else 0) * _TAIL
    if bare[0].islower() or bare[0] in CLOSERS and not tail:
        marks |= _SMALL
    if bare.isalpha() and (len(bare) == 1 and bare.isascii() or bare.lower() in ABBREVIATIONS):
        marks |= _ABBREVIATION
    return marks


def strengths(marks: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each unit of many texts; ``head`` marks the empty unit put before each text.

    It counts where the next visible unit begins: two or more line breaks since the last visible
    one make it a paragraph's end, one makes it a line's; else a stop makes it a sentence's,
    unless the next word is in lower case or the stop is an abbreviation's; white space a word's.
    """
    at = np.arange(len(marks), dtype=np.int32)
    white = (marks & _WHITE) != 0
    seen = np.maximum.accumulate(np.where(white, np.int32(-1), at))
    before = np.empty_like(seen)
    before[:1], before[1:] = -1, seen[:-1]
    prior = np.maximum(before, 0)
    breaks = np.cumsum((marks >> 2) & 3, dtype=np.int32)
    lines = breaks - breaks[prior]
    gap = ((marks & _LEADS) != 0) | (before < at - 1)
    tail = (marks[prior] >> 4) & 3
    short = (marks[np.maximum(prior - 1, 0)] & _ABBREVIATION) != 0
    out = gap.astype(np.uint8)
    out[(tail == _WIDE) | gap & ((marks & _SMALL) == 0) & ((tail == _STOP) | (tail == _DOT) & ~short)] = SENTENCE
    out[lines == 1] = LINE
    out[lines > 1] = PARAGRAPH
    out[white | head[prior]] = INNER
    return out


class Units:
    """What is known of units, remembered per distinct one (at most ``keep`` of up to 64 characters)."""

    def __init__(self, size: Sizer, keep: int = 500_000):
        encode = size.encoding.encode_ordinary

        class Memo(dict):
            def __missing__(self, unit):
                n = min(len(encode(unit)), _TOKENS) | min(len(unit), _CHARS) << _LEN | unit_marks(unit) << _MARK
                if len(unit) <= 64:
                    if len(self) >= keep:
                        self.clear()
                    self[unit] = n
                return n

        self.size, self.codes = size, Memo()


class _Text:
    """One text in units that are never cut: where they start, their tokens, the boundaries' strengths.

    A unit is a word of the tokenizer; a long word is several units, between which its tokens are shared out, so that the
    sums are exact wherever a word begins.
    """

    def __init__(self, text: str, units: Units):
        self.text, self.size, self.codes = text, units.size, units.codes
        words = units.size.words(text)
        code = np.fromiter(map(units.codes.__getitem__, words), np.int64, len(words))
        chars, tokens, marks = (code >> _LEN) & _CHARS, code & _TOKENS, (code >> _MARK).astype(np.int16)
        self.first: list[int] = []  # units with which cut words begin, and those behind their ends
        self.behind: list[int] = []
        if len(code) and (long := np.flatnonzero((tokens > LONG_WORD) & (chars > UNIT_CHARS + 1))).size:
            parts: list[list] = [[], [], []]
            done = n = 0
            for k in long.tolist():
                for part, whole in zip(parts, (chars, tokens, marks)):
                    part.append(whole[done:k])
                n += k - done
                done = k + 1
                word = words[k]
                # No unit of one character at the end: as a text's beginning it could be read together with what follows.
                ends = [*range(UNIT_CHARS, len(word) - 1, UNIT_CHARS), len(word)]
                cells = np.array([0, *ends])
                parts[0].append(np.diff(cells))
                parts[1].append(np.diff(cells * int(tokens[k]) // len(word)))
                parts[2].append(np.array([unit_marks(word[a:b]) for a, b in zip(cells, ends)], np.int16))
                self.first.append(n)
                n += len(ends)
                self.behind.append(n)
            chars, tokens, marks = (np.concatenate([*part, whole[done:]]) for part, whole in zip(parts, (chars, tokens, marks)))
        self.starts = [0, *np.cumsum(chars).tolist()]
        self.sums = [0, *np.cumsum(tokens).tolist()]
        self.marks = marks
        self.white = self.strength = b""

    def _count(self, i: int, j: int) -> int:
        return len(self.size.encoding.encode_ordinary(self.text[self.starts[i] : self.starts[j]]))

    def tokens(self, i: int, j: int) -> int:
        """Of the units i to j as a text of their own.

        Whole words add up.  White space at the end, which the tokenizer reads as one run only there, and
        parts of cut words at both ends are counted anew.
        """
        n = 0
        if j > i and self.white[j - 1]:
            k = j - 1
            while k > i and self.white[k - 1]:
                k -= 1
            n, j = self.codes[self.text[self.starts[k] : self.starts[j]]] & _TOKENS, k
        if self.first and j > i:
            k = bisect_right(self.first, i) - 1
            if k >= 0 and self.first[k] < i < self.behind[k]:
                end = min(self.behind[k], j)
                n += self._count(i, end)
                i = end
            k = bisect_left(self.first, j) - 1
            if j > i and k >= 0 and j < self.behind[k]:
                n += self._count(self.first[k], j)
                j = self.first[k]
        return n + self.sums[j] - self.sums[i]

    def cut(self, i: int, j: int) -> int:
        """The strongest boundary in the middle half, by tokens; of equals the one nearest to the midpoint.  Only where
        the middle half has none is it looked for elsewhere, and only a text without any is cut inside a word."""
        lo_t, hi_t = self.sums[i], self.sums[j]
        quarter = (hi_t - lo_t) / 4
        lo = max(i + 1, bisect_left(self.sums, lo_t + quarter, i, j))
        hi = min(j - 1, bisect_right(self.sums, hi_t - quarter, i, j) - 1)
        if lo > hi:
            return min(max(i + 1, bisect_left(self.sums, (lo_t + hi_t) / 2, i, j)), j - 1)
        mid = min(max(bisect_left(self.sums, (lo_t + hi_t) / 2, lo, hi), lo), hi)
        best = max(self.strength[lo : hi + 1])
        if best == INNER and (anywhere := max(self.strength[i + 1 : j], default=INNER)):
            # No end of a word in the middle half: take the strongest boundary there is.
            lo, hi, best = i + 1, j - 1, anywhere
        right, left = self.strength.find(best, mid, hi + 1), self.strength.rfind(best, lo, mid)
        middle = (lo_t + hi_t) / 2
        return right if left < 0 or right >= 0 and self.sums[right] - middle <= middle - self.sums[left] else left

    def pieces(self, limits: list[tuple[int, int]]) -> list[list[tuple[int, int, int, int]]]:
        """For each (limit, overlap): (first unit with overlap, first own unit, end unit, tokens) in order.

        The cuts do not depend on the limit, only where they stop does: one recursion serves all.
        """
        room = [most - lap for most, lap in limits]
        ends: list[list[int]] = [[] for _ in limits]
        stack = [(0, len(self.starts) - 1, sorted(range(len(limits)), key=lambda x: -room[x]))]
        while stack:
            i, j, active = stack.pop()
            if j - i > 1:
                # Rooms descend: what fits is at the front.
                n, done = self.tokens(i, j), 0
                while done < len(active) and n <= room[active[done]]:
                    ends[active[done]].append(j)
                    done += 1
                more = active[done:] if done else active
            else:
                more = []
                for x in active:
                    ends[x].append(j)
            if more:
                k = self.cut(i, j)
                stack.append((k, j, more))
                stack.append((i, k, more))
        out = []
        for (most, lap), own in zip(limits, ends):
            got, start = [], 0
            for end in own:
                first = start
                if lap and start:
                    first = bisect_left(self.sums, self.sums[start] - lap, 0, start)
                    while first < start and (self.tokens(first, end) > most or self.tokens(first, start) > lap):
                        first += 1
                    # Begin with a word where there is one.
                    first = next((k for k in range(first, start) if self.strength[k]), first)
                got.append((first, start, end, self.tokens(first, end)))
                start = end
            out.append(got)
        return out


def read_texts(texts: list[str], units: Units) -> list[_Text]:
    """Texts in units; the strengths of all their boundaries are found in one pass."""
    out = [_Text(t, units) for t in texts]
    marks = np.zeros(sum(len(t.marks) + 1 for t in out), np.int16)
    head = np.zeros(len(marks), bool)
    at = 0
    for t in out:
        head[at] = True
        marks[at + 1 : at + 1 + len(t.marks)] = t.marks
        at += len(t.marks) + 1
    strength, white, at = strengths(marks, head).tobytes(), (marks & _WHITE).astype(np.uint8).tobytes(), 1
    for t in out:
        n = len(t.marks)
        t.strength, t.white = strength[at : at + n], white[at : at + n]
        at += n + 1
    return out


def split_texts(df: DataFrame, id_col: str, text: str, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts above a piece size in ordered pieces within it.

    ``limits``: limit_name, max_tokens, overlap_tokens (null: none), a table of few rows that is
    read as parameters; the overlap must be below half the limit.  Result per limit and text longer
    than it: limit_name, id_col, piece (from 0), start_char, own_start_char, end_char, n_tokens, text.  The pieces
    without their overlap, joined in order, are the text; a piece begins with the end of the one
    before, as many whole words of it as fit into the overlap.  Pieces end at the strongest boundary near the
    middle of what is cut; only a text without any is cut between characters.  ``n_tokens`` is
    the exact count of the piece's text.  A single character of more tokens than the limit stays whole.
    Null and empty texts and those within the limit give no rows; ids may repeat.

    Each text is cut on its own, within the Arrow batches of its partition: no shuffle.
    """
    sizes = [(r["limit_name"], r["max_tokens"], r["overlap_tokens"] or 0) for r in limits.orderBy("limit_name").collect()]
    for name, most, lap in sizes:
        if most is None or most < 1 or lap < 0 or 2 * lap >= most:
            raise ValueError(f"limit {name}: {most} tokens with an overlap of {lap}")
    data = read_vocabulary(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["limit_name", id_col, "piece", "start_char", "own_start_char", "end_char", "n_tokens", "text"]
    types = [pa.string(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    spans = [(m, o) for _, m, o in sizes]
    least = min((m for m, _ in spans), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(sizer(data))

        def made(ids: pa.Array, row: list, columns: list[list]) -> pa.RecordBatch:
            cells = [ids.take(pa.array(row, pa.int32())) if t is None else pa.array(c, t) for c, t in zip([columns[0], None, *columns[1:]], types)]
            return pa.RecordBatch.from_arrays(cells, names=names)

        for batch in batches:
            # A character has at most four bytes and a token at least one, so short texts need no count.
            texts = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if t and len(t) * 4 > least]
            while texts:
                n, chars = 0, 0
                while n < len(texts) and chars < READ_CHARS:
                    chars += len(texts[n][1])
                    n += 1
                row, columns = [], [[] for _ in range(7)]
                for (i, text), t in zip(texts, read_texts([t for _, t in texts[:n]], units)):
                    total = t.tokens(0, len(t.starts) - 1)
                    chosen = [x for x, (m, _) in enumerate(spans) if total > m]
                    if not chosen:
                        continue
                    starts = t.starts
                    for x, got in zip(chosen, t.pieces([spans[x] for x in chosen])):
                        row += [i] * len(got)
                        columns[0] += [sizes[x][0]] * len(got)
                        columns[1] += range(len(got))
                        for k, part in enumerate(zip(*got)):
                            columns[2 + k] += part if k == 3 else [starts[u] for u in part]
                        columns[6] += [text[starts[a] : starts[c]] for a, _, c, _ in got]
                if row:
                    yield made(batch.column(0), row, columns)
                texts = texts[n:]

    return df.select(id_col, text).mapInArrow(run, f"limit_name string, `{id_col}` {kind}, piece int, start_char long, own_start_char long, end_char long, n_tokens long, text string")
