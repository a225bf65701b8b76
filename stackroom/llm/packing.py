"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into pieces of the full capacity, each of which fills a
sequence, and one tail.  Tails are counted by length class.  A linear program over
patterns (how many tails of each class share a sequence) is solved by column
generation: the dual prices go into a knapsack dynamic program, which finds the
next pattern worth adding.  Patterns are rounded down, what is left over is packed
best fit, and the tails, ranked within their class, take the places in order.

The program sees one count for each class, however many documents there are.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stackroom.llm.common import ranked, ready, written

CAPACITY = 2048
UNIT = 8  # tokens in one step of the length classes
END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}
GAP = 1e-3  # stop when the bound shows that no more than this share can be saved
ROUNDS = 1000  # of pricing, at most

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Byte-level BPE of a vocabulary file of ranks; the end-of-text mark in a text is its id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )

    def __call__(self, text: str) -> list[int]:
        if any(mark in text for mark in SPECIAL):
            return self._bpe.encode(text, allowed_special="all")
        return self._bpe.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder for each worker process and file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenize whole texts and cut each at multiples of ``capacity``: a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        schema = pa.schema([(name.split()[0], pa.int64()) for name in PIECES.split(", ")])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Dynamic program over the room left: the value of the best pattern of sizes
    (ascending) that fits, and for each size the best pattern that has it."""
    value = np.zeros(room + 1)
    choice = np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        value[r] = value[r - 1]
        if n := fits[r]:
            gains = value[r - sizes[:n]] + prices[:n]
            i = int(gains.argmax())
            if gains[i] > value[r]:
                value[r], choice[r] = gains[i], i
    patterns = np.eye(len(sizes), dtype=np.int64)
    for i in range(len(sizes)):
        r = room - sizes[i]
        while r > 0:
            if choice[r] < 0:
                r -= 1
            else:
                patterns[i, choice[r]] += 1
                r -= sizes[choice[r]]
    return float(value[room]), patterns


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used, covering ``demand`` of every size exactly.

    Revised simplex with the basis inverse kept.  Each pricing step offers one new
    pattern for every size; its prices are smoothed towards the best dual point so
    far.  The bound of a pricing step (Farley) ends the search.
    """
    m = len(sizes)
    if not m:
        return []
    patterns = np.diag(room // sizes)
    inverse = np.diag(1.0 / (room // sizes))
    used = demand / (room // sizes)
    bound, best = 0.0, inverse.sum(axis=0)
    for _ in range(ROUNDS):
        tried = (best + np.maximum(inverse.sum(axis=0), 0)) / 2
        value, offered = knapsack(tried, sizes, room)
        if (new := tried @ demand / max(value, 1.0)) > bound:
            bound, best = new, tried / max(value, 1.0)
        if used.sum() <= bound * (1 + gap):
            break
        while True:
            worth = offered @ inverse.sum(axis=0)
            pattern = offered[int(worth.argmax())]
            if worth.max() <= 1 + 1e-7:
                break
            step = inverse @ pattern
            rising = step > 1e-9
            ratio = np.full(m, np.inf)
            ratio[rising] = np.maximum(used[rising], 0) / step[rising]
            out = int(ratio.argmin())
            used = used - ratio[out] * step
            used[out] = ratio[out]
            patterns[:, out] = pattern
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
    counts = np.floor(np.maximum(used, 0) + 1e-6).astype(np.int64)
    left = demand - patterns @ counts
    for j in np.flatnonzero((patterns > 0).T @ (left < 0)):  # rounding errors of the basis
        while counts[j] and (left[patterns[:, j] > 0] < 0).any():
            counts[j] -= 1
            left = left + patterns[:, j]
    plan = [(int(n), patterns[:, j].copy()) for j, n in enumerate(counts) if n]
    return plan + [(1, p) for p in best_fit(sizes, left, room)]


def best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Fill one sequence after another: the largest size that fits, again and again."""
    left, out = left.copy(), []
    while left.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        while (fits := np.flatnonzero((left > 0) & (sizes <= free))).size:
            i = fits[-1]
            n = min(left[i], free // sizes[i])
            pattern[i] += n
            left[i] -= n
            free -= n * sizes[i]
        out.append(pattern)
    return out


def pack(
    docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, vocabulary: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Needs doc_id and text; other columns are ignored, whatever their names.  A null or
    empty text is one piece, the end id.  Repeated rows and repeated doc_ids are
    packed each for themselves; a null doc_id stays null.  An empty table gives no rows.
    Which of two equal tails gets which place follows a hash of its key and content.
    """
    spark = ready(docs.sparkSession)
    cut_rows = cut(docs, capacity, vocabulary).withColumn("_row", F.monotonically_increasing_id())
    rows = written(cut_rows, "pieces")
    tails = rows.where(F.col("length") < capacity).withColumn("_size", F.ceil(F.col("length") / unit).cast("int"))
    full = rows.where(F.col("length") == capacity)

    # at most capacity / unit rows
    counts = {row["_size"]: row["count"] for row in tails.groupBy("_size").count().collect()}
    sizes = np.array(sorted(counts), np.int64)
    plan = solve(sizes, np.array([counts[s] for s in sizes], np.int64), capacity // unit)

    places, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for n, pattern in plan:
        slot = 0
        for i in np.flatnonzero(pattern):
            size, each = int(sizes[i]), int(pattern[i])
            places.append((size, taken[size], taken[size] + n * each, each, sequence, slot))
            taken[size] += n * each
            slot += each
        sequence += n
    # the plan's size depends on the number of classes only, so it is sent to all executors
    shape = "_size int, _from bigint, _to bigint, _each bigint, _sequence bigint, _slot bigint"
    plan_rows = F.broadcast(spark.createDataFrame(places, shape))

    rank = F.col("_rank") - F.col("_from")
    placed = (
        ranked(tails, ["_size"], ["_row"], "_rank")
        .join(plan_rows, "_size")
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumn("sequence_id", F.col("_sequence") + F.floor(rank / F.col("_each")))
        .withColumn("_at", F.col("_slot") + rank % F.col("_each"))
    )
    # a sequence holds at most ``capacity`` pieces
    together = Window.partitionBy("sequence_id")
    before = together.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn(
        "sequence_tokens", F.sum("length").over(together)
    )
    alone = ranked(full.withColumn("_all", F.lit(0)), ["_all"], ["_row"], "_rank")
    alone = alone.withColumn("sequence_id", F.col("_rank") + sequence)
    alone = alone.withColumn("offset", F.lit(0).cast("bigint")).withColumn("sequence_tokens", F.col("length"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    return placed.select(*names).unionByName(alone.select(*names))
