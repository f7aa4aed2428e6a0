"""Fill-in-the-middle transformation (operator 12): repeated-capture matching.

One ``regex`` fullmatch of ``(unit)*`` over a text keeps the end of every repetition:
``match.ends(1)`` is the list of all unit ends, so its length is the number of units n and the two
cut offsets are two of its entries; no loop over the units is written. ``unit`` is a pattern of
one non-empty unit that can match in one way only (possessive quantifiers); by default it is one
code point. Texts longer than ``window`` code points are matched in windows, so that any text
needs the memory of one; the last unit of a window, which may be cut, opens the next one.

A row is drawn by the sha256 of ``1:`` and its decimal doc_id: the first four 8-digit groups give
the two cuts, the form and the order. The sentinels never occur in a text that is cut, so
:func:`restored` takes the three pieces from the output and its form alone.

Defined results: a null text is the empty text and stays plain; a null doc_id is drawn by ``1:``
alone; rows that repeat a doc_id are drawn alike and each gives a row; an empty table gives an
empty result; further columns are not read. A text that is not a sequence of units raises.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import map_batches, texts

#: Sentinels before the prefix, the suffix and the middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of the texts that stay plain, and percent of the others in suffix-first order.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
CODE_POINT = r"(?s:.)"
#: Code points of one match; the ends of a window take about 40 bytes a unit.
WINDOW = 1 << 18


def draw(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four 32-bit numbers that decide about a row."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i:8 * i + 8], 16) for i in range(4))


class UnitCutter:
    """Number of units of a text and the offsets at which given numbers of units end."""

    def __init__(self, unit: str = CODE_POINT, window: int = WINDOW):
        self.units = regex.compile(f"({unit})*")
        self.window = window

    def _ends(self, text: str, start: int) -> list[int]:
        """Ends of the units of the window at ``start``."""
        stop = start + self.window
        while stop < len(text):
            ends = m.ends(1) if (m := self.units.match(text, start, stop)) else []
            if len(ends) > 1:
                return ends[:-1]  # the last unit may go on behind the window
            stop += stop - start
        found = self.units.fullmatch(text, start)
        if found is None:
            raise ValueError("a text is not a sequence of units")
        return found.ends(1)

    def count(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """Units in all, and for each window the units before it and the offset where it starts."""
        n, at, windows = 0, 0, []
        while at < len(text):
            windows.append((n, at))
            ends = self._ends(text, at)
            n, at = n + len(ends), ends[-1]
        return n, windows

    def cuts(self, text: str, choose) -> tuple[int, int, int]:
        """``n`` and the offsets after ``choose(n)``, two numbers of units in ascending order."""
        if len(text) <= self.window:
            ends = [0, *self._ends(text, 0)] if text else [0]
            first, second = choose(len(ends) - 1)
            return len(ends) - 1, ends[first], ends[second]
        n, windows = self.count(text)
        return n, *(self._offset(text, windows, k) for k in choose(n))

    def _offset(self, text: str, windows: list[tuple[int, int]], k: int) -> int:
        before, start = next(w for w in reversed(windows) if w[0] <= k)
        return self._ends(text, start)[k - before - 1] if k > before else start


def transform(text: str, doc_id: int | None, cutter: UnitCutter) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix and middle code points, output`` of one text."""
    h1, h2, h3, h4 = draw(doc_id)
    n, first, second = cutter.cuts(text, lambda n: sorted((h1 % (n + 1), h2 % (n + 1))))
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SPM_PERCENT:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, len(prefix), len(middle), output


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cutter = UnitCutter(unit)
        rows = [transform(x.as_py(), d, cutter) for d, x in zip(batch.column(0).to_pylist(), batch.column(1))]
        n, form, prefix, middle, output = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
             pa.array(middle, pa.int64()), pa.array(output, pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(texts(docs), run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text rebuilt from a row's output and form."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # the first one is empty
    piece = [F.get(parts, F.lit(i)) for i in range(4)]
    return (F.when(F.col(form) == "psm", F.concat(piece[1], piece[3], piece[2]))
            .when(F.col(form) == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(F.col(output)))
