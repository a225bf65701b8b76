"""Removal of repeated passages: seeds from winnowed anchors, extended both ways.

A window is ``width`` consecutive words.  Each window has an anchor: the leftmost of
its runs of ``seed`` words with the smallest hash.  Equal windows have equal anchors at
equal places, so documents that share a window meet at an anchor.  Consecutive
windows with one anchor make a neighbourhood: the anchor extended to the left and
right as far as its windows reach.  Maximal repeats are what adjoining repeated
windows cover.

1. Anchors, each with the hash of its neighbourhood, are sorted by anchor.  Where a
   neighbourhood occurs in an earlier document, all its windows do.
2. The first document of each neighbourhood whose anchor has others beside it asks for
   more: its windows are compared one by one, as two neighbourhoods may share some.
3. Each document gets the hashes it has to remove, and is read once more.

A document that occurs thousands of times costs one row for each of its anchors;
no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackroom.llm.arrays import WORDS_BASE, Words, mix, pieces, prefix_sums, run_hash, signed, split_words, text_bytes
from stackroom.llm.common import ready, shape_of, shuffle_width, together

WINDOW = 20
SEED = 8
U = np.uint64


class Windows:
    """Windows and neighbourhoods of the words of several texts."""

    def __init__(self, words: Words, width: int, seed: int):
        self.words = words
        self.width = width
        sums = prefix_sums(mix(words.hash), WORDS_BASE)
        owner = words.owner()
        start = np.arange(len(owner))
        # windows that stay inside their text
        stop = words.at[1:][owner] if len(owner) else start
        self.start = start[start + width <= stop]
        self.owner = owner[self.start]
        self._sums = sums
        last = len(owner) - seed + 1
        if not len(self.start):
            self.anchor_at = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, U)
        else:
            grams = run_hash(sums, np.arange(last), np.arange(last) + seed, WORDS_BASE)
            at = self._leftmost_smallest(grams, width - seed + 1)
            self.anchor_at = at[self.start]
            self.anchor = grams[self.anchor_at]

    @staticmethod
    def _leftmost_smallest(values: np.ndarray, count: int) -> np.ndarray:
        """Place of the smallest of ``count`` values from each place on, by doubling."""
        at = np.arange(len(values))
        reach, best = 1, at
        parts = []
        rest, offset = count, 0
        while rest:
            if rest & 1:
                parts.append((offset, best))
                offset += reach
            rest >>= 1
            if rest:
                best = Windows._smaller(values, best, reach)
                reach *= 2
        offset, out = parts[0]
        for shift, best in parts[1:]:
            moved = np.full(len(values), len(values) - 1)
            moved[: len(values) - shift] = best[shift:]
            out = np.where(values[moved] < values[out], moved, out)
        return out

    @staticmethod
    def _smaller(values: np.ndarray, best: np.ndarray, reach: int) -> np.ndarray:
        n = len(best)
        moved = best.copy()
        if reach < n:
            moved[: n - reach] = best[reach:]
        return np.where(values[moved] < values[best], moved, best)

    def hashes(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        start = self.start[which]
        return run_hash(self._sums, start, start + self.width, WORDS_BASE)

    def neighbourhoods(self) -> tuple[np.ndarray, np.ndarray]:
        """First window of each neighbourhood, and a hash of its words and the anchor's place in it."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, U)
        new = np.ones(len(self.start), bool)
        new[1:] = (self.anchor_at[1:] != self.anchor_at[:-1]) | (self.owner[1:] != self.owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(self.start)) - 1
        content = run_hash(self._sums, self.start[first], self.start[last] + self.width, WORDS_BASE)
        place = (self.anchor_at[first] - self.start[first]).astype(U)
        return first, mix(content ^ (place + U(1)) * U(0x9E3779B97F4A7C15))


def _tell(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for a text of the batch and a hash."""
    return mix(value + mix(owner.astype(U) + U(1)))


def _flat(lists: pa.Array) -> np.ndarray:
    """Owner-marked values of a list column: see :func:`_tell`."""
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return _tell(owner, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U))


ANCHORS = "anchor bigint, near bigint, doc_id bigint"
FOUND = "doc_id bigint, near bigint, earlier boolean"


def _anchors(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                windows = Windows(split_words(part.column(1)), width, seed)
                first, near = windows.neighbourhoods()
                owner = windows.owner[first]
                _, once = np.unique(_tell(owner, near), return_index=True)
                ids = part.column(0).to_numpy(zero_copy_only=False)[owner[once]]
                columns = [signed(windows.anchor[first[once]]), signed(near[once]), ids.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "near", "doc_id"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, neighbourhood and document: who is later, and who has to ask.

    Of a group as long as may be only its last neighbourhood's first document is kept in mind.
    """
    names = ["doc_id", "near", "earlier"]
    held = None  # (anchor, near, doc_id, whether its anchor had another neighbourhood before)
    for batch in batches:
        anchor, near, doc = (c.to_numpy() for c in batch.columns)
        if not len(anchor):
            continue
        n = len(anchor)
        before_anchor = np.concatenate(([held[0] if held else ~anchor[0]], anchor[:-1]))
        before_near = np.concatenate(([held[1] if held else 0], near[:-1]))
        new_anchor = anchor != before_anchor
        new_near = new_anchor | (near != before_near)
        lead = np.maximum.accumulate(np.where(new_near, np.arange(n), -1))
        first_doc = np.where(lead >= 0, doc[lead], held[2] if held else 0)
        later = doc > first_doc
        heads = np.flatnonzero(new_near)
        out_doc, out_near, out_earlier = [doc[later]], [near[later]], [np.ones(later.sum(), bool)]

        def ask(docs, nears):
            out_doc.append(docs), out_near.append(nears), out_earlier.append(np.zeros(len(docs), bool))

        if len(heads):
            if held and (held[3] or not new_anchor[heads[0]]):
                ask(np.array([held[2]]), np.array([held[1]]))
            not_first = ~new_anchor[heads]
            followed = np.append(not_first[1:], False)
            asking = heads[:-1][(not_first | followed)[:-1]]
            ask(doc[asking], near[asking])
            i = heads[-1]
            held = (anchor[i], near[i], doc[i], bool(not_first[-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in (out_doc, out_near, out_earlier)], names=names
        )
    if held and held[3]:
        yield pa.RecordBatch.from_arrays([pa.array([held[2]]), pa.array([held[1]]), pa.array([False])], names=names)


def _asked_windows(width: int, seed: int):
    """Windows of the neighbourhoods that a document asks about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                windows = Windows(split_words(part.column("_text")), width, seed)
                first, near = windows.neighbourhoods()
                asked = np.isin(_tell(windows.owner[first], near), _flat(part.column("asked")))
                which = np.flatnonzero(np.repeat(asked, np.diff(np.append(first, len(windows.start)))))
                hashes = windows.hashes(which)
                _, once = np.unique(_tell(windows.owner[which], hashes), return_index=True)
                which = which[once]
                ids = part.column("doc_id").to_numpy()[windows.owner[which]]
                columns = [signed(windows.anchor[which]), signed(hashes[once]), ids.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "near", "doc_id"])

    return run


KEPT = "n_words bigint, n_removed bigint, kept_sha256 string"


def _apply(width: int, seed: int, text_out: bool):
    """Remove the words of every window that occurs earlier, elsewhere or in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                words = split_words(part.column("_text"))
                windows = Windows(words, width, seed)
                hashes = windows.hashes()
                mark = _tell(windows.owner, hashes)
                gone = np.isin(mark, _flat(part.column("_windows")))
                first, near = windows.neighbourhoods()
                earlier = np.isin(_tell(windows.owner[first], near), _flat(part.column("_nears")))
                gone |= np.repeat(earlier, np.diff(np.append(first, len(windows.start))))
                _, once = np.unique(mark, return_index=True)  # the first of equal windows in a text
                again = np.ones(len(mark), bool)
                again[once] = False
                gone |= again
                edges = np.zeros(len(words.start) + 1, np.int64)
                at = windows.start[gone]
                np.add.at(edges, at, 1)
                np.add.at(edges, at + width, -1)
                removed = np.cumsum(edges[:-1]) > 0
                texts = _joined(words, ~removed)
                counts = np.concatenate(([0], np.cumsum(removed)))[words.at]
                columns = [
                    part.column("given"),
                    pa.array(words.counts, pa.int64()),
                    pa.array(np.diff(counts), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                names = ["given", "n_words", "n_removed", "kept_sha256"]
                if text_out:
                    laid_out = _laid_out(words, ~removed, text_bytes(part.column("_text"))[1][1:])
                    given = part.column("_text").to_pylist()
                    same = (np.diff(counts) == 0).tolist()
                    kept = [g if s else t.decode() for g, s, t in zip(given, same, laid_out)]
                    columns.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _joined(words: Words, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    length = np.where(kept, words.end - words.start + 1, 0)
    raw, bounds = _gathered(words, kept, length, one_space=True)
    return [raw[a : max(a, b - 1)] for a, b in bounds]


def _laid_out(words: Words, kept: np.ndarray, text_ends: np.ndarray) -> list[bytes]:
    """The kept words of each text, each with the white space that follows it there."""
    after = np.append(words.start[1:], 0)
    last = words.at[1:][words.counts > 0] - 1
    after[last] = text_ends[words.counts > 0]
    raw, bounds = _gathered(words, kept, np.where(kept, after - words.start, 0), one_space=False)
    return [raw[a:b].rstrip(b" \t\n\v\f\r") for a, b in bounds]


def _gathered(words: Words, kept: np.ndarray, length: np.ndarray, one_space: bool) -> tuple[bytes, list[tuple[int, int]]]:
    out_at = np.concatenate(([0], np.cumsum(length)))
    chosen = np.flatnonzero(kept)
    source = np.repeat(words.start[chosen] - out_at[chosen], length[chosen]) + np.arange(out_at[-1])
    if one_space:
        space = out_at[1:][chosen] - 1
        source[space] = 0
    out = words.data[source] if len(source) else np.zeros(0, np.uint8)
    if one_space:
        out[space] = 32
    at = out_at[words.at].tolist()
    return out.tobytes(), list(zip(at[:-1], at[1:]))


def repeats(named: DataFrame, width: int = WINDOW, seed: int = SEED) -> DataFrame:
    """What each document has to remove: doc_id, ``_nears`` (neighbourhoods), ``_windows`` (single windows).

    ``named`` is (given, doc_id, _text).  ``given`` goes along to the windows so that the texts are
    dealt by doc_id as they are for the removal: Spark then shuffles them once for both.
    """
    n = shuffle_width(named.sparkSession)
    anchors = named.select("doc_id", F.col("_text").alias("text")).mapInArrow(_anchors(width, seed), ANCHORS)
    sort = ["anchor", "near", "doc_id"]
    found = anchors.repartition(n, "anchor").sortWithinPartitions(*sort).mapInArrow(_meet, FOUND)
    asking = found.where(~F.col("earlier")).groupBy("doc_id").agg(F.collect_set("near").alias("asked"))
    asked = named.join(asking, "doc_id").select("given", "doc_id", "_text", "asked")
    windows = asked.mapInArrow(_asked_windows(width, seed), ANCHORS)
    # the same rule once more, on single windows: the later ones go
    again = windows.repartition(n, "anchor", "near").sortWithinPartitions(*sort).mapInArrow(_meet, FOUND)
    nears = found.where("earlier").select("doc_id", "near", F.lit(0).alias("kind"))
    singles = again.where("earlier").select("doc_id", "near", F.lit(1).alias("kind"))
    pick = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("near")))
    return nears.unionByName(singles).groupBy("doc_id").agg(pick(0).alias("_nears"), pick(1).alias("_windows"))


def drop_repeats(
    docs: DataFrame, width: int = WINDOW, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",), kept_text: bool = False
) -> DataFrame:
    """Remove every word covered by a window whose words also start earlier.

    Earlier: in a document of smaller doc_id, or before in the same text.  Gives the
    columns ``keep`` of each input row, n_words, n_removed, kept_sha256 (of the kept words joined
    by one space) and, if asked, kept_text: the text itself where nothing goes, else
    the kept words with the white space that follows each.  Needs doc_id and text; others
    are ignored unless kept.  Null and empty texts have no words.  Rows of equal
    doc_id are judged each for itself: none is earlier than the other.  A row without
    doc_id loses only what repeats inside it, and makes nothing else go.  An empty
    table gives no rows.
    """
    ready(docs.sparkSession)
    empty = F.array().cast("array<bigint>")
    shape = KEPT + ", kept_text string" * kept_text
    given, back = together(keep, shape)
    named = docs.select(
        given, F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    )
    known, unknown = named.where(F.col("doc_id").isNotNull()), named.where(F.col("doc_id").isNull())
    joined = known.join(repeats(known, width, seed), "doc_id", "left").select(
        "given", "_text", F.coalesce("_nears", empty).alias("_nears"), F.coalesce("_windows", empty).alias("_windows")
    )
    joined = joined.unionByName(unknown.select("given", "_text", empty.alias("_nears"), empty.alias("_windows")))
    told = joined.mapInArrow(_apply(width, seed, kept_text), shape_of(joined, shape))
    return told.select(*back, *[part.split()[0] for part in shape.split(", ")])
