"""Fill-in-middle: cut texts at word boundaries found through a Fenwick tree over blocks.

A text is cut into fixed blocks of bytes; how many units and code points start in each
block goes into a Fenwick tree.  To cut after ``m`` units, binary lifting descends the tree
to the block in which unit ``m`` starts, with the units and code points before that block;
the boundary itself is then looked for inside that block only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackroom.llm.arrays import text_bytes
from stackroom.llm.common import ready

BLOCK = 2048
WINDOW = 512  # blocks that are looked at together while counting
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True


def starts(data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Where units and code points start among the bytes ``[low, high)`` of a text."""
    part = data[low:high]
    points = (part & 0xC0) != 0x80
    letter = LETTER[part]
    inside = np.empty(len(part), bool)
    inside[1:] = letter[:-1]
    inside[:1] = low > 0 and LETTER[data[low - 1]]
    return points & ~(letter & inside), points


class Boundaries:
    """Fenwick tree of a text's blocks: counts of units and of code points that start in them."""

    def __init__(self, data: np.ndarray):
        self._data = data
        self._blocks = -(-len(data) // BLOCK)
        sums = np.zeros((self._blocks + 1, 2), np.int64)
        for first in range(0, self._blocks, WINDOW):
            flags = starts(data, first * BLOCK, min(len(data), (first + WINDOW) * BLOCK))
            edges = np.arange(0, len(flags[0]), BLOCK)
            for column, flag in enumerate(flags):
                sums[first + 1 : first + 1 + len(edges), column] = np.add.reduceat(flag, edges, dtype=np.int64)
        np.cumsum(sums, axis=0, out=sums)
        self.units, self.points = sums[-1].tolist()
        node = np.arange(self._blocks + 1)
        tree = sums - sums[node - (node & -node)]
        self._units, self._points = tree[:, 0].tolist(), tree[:, 1].tolist()

    def after(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units >= self.units:
            return len(self._data), self.points
        block, points, step = 0, 0, 1 << self._blocks.bit_length()
        while step:
            if block + step <= self._blocks and self._units[block + step] <= units:
                block += step
                units -= self._units[block]
                points += self._points[block]
            step >>= 1
        low = block * BLOCK
        unit_starts, point_starts = starts(self._data, low, min(len(self._data), low + BLOCK))
        inside = int(np.flatnonzero(unit_starts)[units])
        return low + inside, points + int(np.count_nonzero(point_starts[:inside]))


@dataclass
class Infilled:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def transform(doc_id: int | None, data: np.ndarray) -> Infilled:
    """The text (UTF-8 bytes) in its form, by numbers drawn from the doc_id."""
    found = Boundaries(data)
    text = data.tobytes()
    one, two, three, four = draws(doc_id)
    if not text or three % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Infilled(found.units, "plain", None, None, text)
    first, last = sorted(n % (found.units + 1) for n in (one, two))
    (low, before), (high, upto) = found.after(first), found.after(last)
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    spm = four % 100 < SPM_BELOW
    parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return Infilled(found.units, "spm" if spm else "psm", before, upto - before, b"".join(parts))


def restore(output: bytes, form: str) -> bytes:
    """The text that was transformed.  Its parts hold no marks, so the marks found first are those put in."""
    if form == "plain":
        return output
    head, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(head))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(head) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


RESULTS = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
    "output_sha256 string, restored_sha256 string"
)


def fill_in_middle(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Whole texts in the forms plain, psm or spm, and the texts restored from them, as digests.

    With ``keep`` the output itself comes too, as ``output``.  Units are runs of A-Z and a-z
    and every other code point.  Needs doc_id and text; other columns are ignored, whatever their
    names.  One row for each input row, repeated or not; null text counts as empty, an empty
    text is plain with no units; a null doc_id draws its numbers from ``1:`` alone; an empty
    table gives no rows.  A long text takes its own size some times over in a worker.
    """
    shape = RESULTS + (", output string" if keep else "")
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (part.split() for part in shape.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                made = transform(doc_id, data[at[i] : at[i + 1]])
                digests = [hashlib.sha256(x).hexdigest() for x in (made.output, restore(made.output, made.form))]
                row = [doc_id, made.n, made.form, made.prefix_chars, made.middle_chars, *digests]
                rows.append(row + [made.output.decode()] * keep)
            columns = zip(*rows) if rows else [[]] * len(fields)
            arrays = [pa.array(column, field.type) for column, field in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, shape)
