"""Exact duplicates by recipes of content-defined chunks.

A normalised text is cut where a hash of the last bytes says so, so equal texts are cut
alike.  What leaves the first pass is a recipe: the key (64 bits) and SHA-256 of each
chunk, in order; texts are read once and not moved.  Chunks are deduplicated to
identifiers that are verified: a key names a chunk only together with a variant, which
tells chunks of one key and different SHA-256 apart.  Documents are equal when their
ordered identifiers are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stackroom.llm.arrays import BYTE_CODES, BYTES_BASE, LOWER, mix, pieces, prefix_sums, run_hash, signed, text_bytes
from stackroom.llm.common import ready, written
from stackroom.operators.skew import lookup_join

LOOK_BACK = 32  # bytes that decide about a cut
SMALLEST = 256
MASK = np.uint64((1 << 10) - 1)  # a cut about every 1024 bytes

RECIPES = "doc_id bigint, text_sha256 string, keys array<bigint>, digests array<binary>"


def cuts(sums: np.ndarray, at: np.ndarray, smallest: int = SMALLEST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, and each text's range of chunks; every text has one at least."""
    n = len(sums) - 1
    ends = np.arange(LOOK_BACK, n)
    rolling = mix((sums[ends] - sums[ends - LOOK_BACK]) * BYTES_BASE.down[ends - LOOK_BACK])
    marked = ends[(rolling & MASK) == 0]
    inside = np.searchsorted(marked, at)
    out, counts = [], []
    for i in range(len(at) - 1):
        low, high = at[i], at[i + 1]
        last, first = low, len(out)
        for end in marked[inside[i] : inside[i + 1]].tolist():
            if end - last >= smallest and end - low >= LOOK_BACK:
                out.append(end)
                last = end
        if last < high or high == low:
            out.append(high)
        counts.append(len(out) - first)
    return np.array(out, np.int64), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            data, at = text_bytes(part.column(1))
            data = LOWER[data]
            sums = prefix_sums(BYTE_CODES[data], BYTES_BASE)
            ends, chunks_at = cuts(sums, at)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            starts[chunks_at[:-1]] = at[:-1]
            keys = run_hash(sums, starts, ends, BYTES_BASE)
            raw = memoryview(data.tobytes())
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist())]
            whole = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            offsets = pa.array(chunks_at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(whole, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(signed(keys))),
                    pa.ListArray.from_arrays(offsets, pa.array(digests, pa.binary())),
                ],
                names=["doc_id", "text_sha256", "keys", "digests"],
            )


def groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones the row with
    the largest doc_id stays (of repeated rows of that doc_id, one).  Null text counts
    as empty; a null doc_id is smaller than all others.  Needs doc_id and text; other
    columns are ignored.  An empty table gives no rows.
    """
    ready(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = written(given.mapInArrow(_recipes, RECIPES).withColumn("_row", F.monotonically_increasing_id()), "recipes")

    zipped = F.posexplode(F.arrays_zip("keys", "digests")).alias("at", "chunk")
    chunks = recipes.select("_row", zipped).select("_row", "at", F.col("chunk.keys").alias("key"), F.col("chunk.digests").alias("digest"))
    # chunks that share a key are a handful at most; of one chunk all copies are one row here
    same_key = Window.partitionBy("key").orderBy("digest")
    known = chunks.select("key", "digest").distinct().withColumn("variant", F.row_number().over(same_key) - 1)
    told = lookup_join(chunks, known, ["key", "digest"], "inner")
    steps = F.sort_array(F.collect_list(F.struct("at", "key", "variant")))
    ordered = told.groupBy("_row").agg(steps.alias("steps"))
    ordered = ordered.select(
        "_row",
        F.transform("steps", lambda s: s["key"]).alias("keys"),
        F.transform("steps", lambda s: s["variant"]).alias("variants"),
    )
    recipe = ["keys", "variants"]
    named = written(ordered.join(recipes.select("_row", "doc_id", "text_sha256"), "_row"), "identifiers")
    equal = named.groupBy(*recipe).agg(F.max(F.struct("doc_id", "_row")).alias("stays"), F.count("*").alias("group_size"))
    return lookup_join(named, equal, recipe, "inner").select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("stays._row")).alias("kept"),
        "text_sha256",
    )
