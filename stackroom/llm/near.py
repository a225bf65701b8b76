"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the set of its shingles (runs of five words, A-Z lowered).  ProbMinHash lets every
shingle arrive again and again as a Poisson process whose rate is its weight; each arrival hits one
register of the sketch, which keeps its first visitor.  A shingle stops once its next arrival is later
than every register's first.  Two sketches agree in a register with the probability Jaccard
similarity of the weights.  Links are judged by sets, so most bands come of sketches in which each
shingle weighs 1, where this is the Jaccard similarity of the sets; further bands come of sketches
in which it weighs as often as it occurs.

Documents of equal words are one class from the start.  The others meet in buckets of
four equal registers.  Links hold if the shingle sets have a Jaccard similarity of 0.8 or more.
A document is first tried with the nearest (by outlines, see below) of the first members of its buckets.  Where a
bucket then holds several classes, all its pairs of different classes are met: the nearest pair of each
class first, as long as classes join by it, then what is left.  What has become one class is not tried
any more.  A pair goes without reading texts only where it cannot hold: by the numbers of
shingles and by outlines, bits that say which of ``CELLS`` cells a document's shingles fall into.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stackroom.llm.arrays import WORDS_BASE, mix, pieces, prefix_sums, run_hash, signed, split_words
from stackroom.llm.common import ready, written
from stackroom.operators.skew import lookup_join

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
WEIGHTED_BANDS = 4  # further ones, of sketches weighted by counts
ROWS = 4
CELLS = 1024  # of an outline
ROUNDS = 2  # in which each class tries its nearest pair, before all pairs that are left
CHUNK = 32  # pairs that share one copy of their first document's text
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: their text's number (ascending), hash, and count.

    A text of fewer words than ``length`` is one shingle, if it has words.
    """
    words = split_words(column, lower=True)
    sums = prefix_sums(mix(words.hash), WORDS_BASE)
    owner = words.owner()
    start = np.arange(len(owner))
    stop = words.at[1:][owner] if len(owner) else start
    begins = words.at[:-1][owner] if len(owner) else start
    chosen = (start + length <= stop) | (start == begins)
    start, owner, end = start[chosen], owner[chosen], np.minimum(start + length, stop)[chosen]
    hashes = run_hash(sums, start, end, WORDS_BASE)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(owner)))


def prob_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Sketch of each text: which element arrives first at each register."""
    first = np.full(texts * registers, np.inf)
    visitor = np.zeros(texts * registers, U)
    latest = np.full(texts, np.inf)
    time = np.zeros(len(owner))
    seed = element
    round_ = 0
    while len(owner):
        seed = mix(seed + STEP)
        uniform = ((seed >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight
        slot = owner * registers + (mix(seed) % U(registers)).astype(np.int64)
        sooner = np.flatnonzero(time < first[slot])
        np.minimum.at(first, slot[sooner], time[sooner])
        won = sooner[time[sooner] == first[slot[sooner]]]
        visitor[slot[won]] = element[won]
        round_ += 1
        if round_ < 8 or round_ % 8 == 0:
            live = np.unique(owner)
            latest[live] = first.reshape(texts, registers)[live].max(axis=1)
        active = time < latest[owner]
        owner, element, weight, time, seed = owner[active], element[active], weight[active], time[active], seed[active]
    return visitor.reshape(texts, registers)


SKETCH = "doc_id bigint, content_a bigint, content_b bigint, bands array<bigint>, size int, outline array<bigint>"


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: int = WEIGHTED_BANDS) -> DataFrame:
    """Two hashes of each text's words, the hash of each band of its sketches (none without words),
    the number of its shingles, and which of ``CELLS`` cells they fall into, as bits."""
    every = bands + weighted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                words = split_words(part.column(1), lower=True)
                hashes = mix(words.hash)
                whole = [
                    run_hash(prefix_sums(values, WORDS_BASE), words.at[:-1], words.at[1:], WORDS_BASE)
                    for values in (hashes, mix(hashes + STEP))
                ]
                owner, element, count = shingles(part.column(1))
                seen = prob_min_hash(owner, element, np.ones(len(owner)), n, bands * rows)
                if weighted:
                    heavy = prob_min_hash(owner, mix(element + STEP), count.astype(np.float64), n, weighted * rows)
                    seen = np.concatenate([seen, heavy], axis=1)
                keys = np.zeros((n, every), U) + mix(np.arange(1, every + 1, dtype=U) * STEP)
                for i in range(rows):
                    keys = mix(keys + seen[:, i::rows])
                keys = keys[words.counts > 0]
                offsets = np.concatenate(([0], np.cumsum(np.where(words.counts > 0, every, 0))))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(keys.ravel())))
                cells = np.zeros((n, CELLS), bool)
                cells[owner, (mix(element + STEP) % U(CELLS)).astype(np.int64)] = True
                words_of_bits = np.packbits(cells, axis=1).view(np.int64)
                outlines = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (CELLS // 64), pa.int32()), pa.array(words_of_bits.ravel()))
                sizes = pa.array(np.bincount(owner, minlength=n).astype(np.int32))
                columns = [part.column(0), pa.array(signed(whole[0])), pa.array(signed(whole[1])), lists, sizes, outlines]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content_a", "content_b", "bands", "size", "outline"])

    return docs.mapInArrow(run, SKETCH)


def _verify(similarity: float):
    """Rows sorted by group, the group's first document before its partners: which pairs hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_set, held_doc = None, None, None
        for batch in batches:
            for part in pieces(batch):
                first, chunk, doc = (part.column(i).to_numpy() for i in range(3))
                owner, hashes, _ = shingles(part.column("text"))
                at = np.searchsorted(owner, np.arange(part.num_rows + 1))
                out = []
                for i in range(part.num_rows):
                    mine = hashes[at[i] : at[i + 1]]
                    if (first[i], chunk[i]) != held_key or doc[i] == first[i]:
                        held_key, held_set, held_doc = (first[i], chunk[i]), mine, doc[i]
                        continue
                    if held_doc != first[i]:
                        continue
                    small, large = sorted((len(mine), len(held_set)))
                    if small < similarity * large:
                        continue
                    both = np.intersect1d(mine, held_set, assume_unique=True).size
                    if both + 1e-9 >= similarity * (len(mine) + len(held_set) - both):
                        out.append((first[i], doc[i]))
                columns = list(zip(*out)) if out else [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar.

    A document with many partners is sent once for each ``CHUNK`` of them, more or less.
    """
    many = pairs.groupBy("a").agg((F.count("*") / CHUNK).cast("int").alias("_chunks"))
    dealt = lookup_join(pairs, many, ["a"], "inner").withColumn(
        "chunk", F.pmod(F.xxhash64("b"), F.col("_chunks") + 1)
    )
    dealt = written(dealt.select("a", "b", "chunk"), "dealt")
    firsts = dealt.select("a", "chunk").distinct().withColumn("doc_id", F.col("a"))
    rows = firsts.unionByName(dealt.select("a", "chunk", F.col("b").alias("doc_id")))
    rows = lookup_join(rows, texts, ["doc_id"], "inner").select("a", "chunk", "doc_id", "text", (F.col("doc_id") != F.col("a")).alias("_later"))
    dealt_rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "_later", "doc_id").drop("_later")
    return dealt_rows.mapInArrow(_verify(similarity), "a bigint, b bigint")


def rooted(parents: DataFrame) -> DataFrame:
    """The root (``class_id``) of each document of a forest (doc_id, parent), whose parents are smaller.

    Each round goes twice as far up.
    """
    labels = written(parents.select("doc_id", F.col("parent").alias("class_id")), "labels")
    while True:
        up = labels.select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("_up"))
        labels = written(lookup_join(labels, up, ["class_id"], "left").select("doc_id", F.coalesce("_up", "class_id").alias("class_id"), "_up"), "labels")
        if labels.where("_up is not null").isEmpty():
            return labels.select("doc_id", "class_id")
        labels = labels.select("doc_id", "class_id")


def components(links: DataFrame) -> DataFrame:
    """Smallest document (``class_id``) that each linked document reaches.

    In each round every document with a smaller neighbour hangs on to the smallest; trees become one document
    each, and links between trees are what is left for the next round.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = written(links.select(low.alias("a"), high.alias("b")).where("a < b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        moved = rooted(links.groupBy("b").agg(F.min("a").alias("parent")).select(F.col("b").alias("doc_id"), "parent"))
        labels = moved if labels is None else relabelled(labels, moved)
        links = classed(links.select("a", "b"), moved)
        links = written(links.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct(), "links")
    if labels is None:
        return links.toDF("doc_id", "class_id")
    return labels.union(labels.select("class_id", "class_id")).distinct()


def relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """Labels (doc_id, class_id) after classes have moved to others: those of ``moved`` (doc_id, class_id)."""
    found = lookup_join(labels, moved.toDF("class_id", "_to"), ["class_id"], "left").select("doc_id", F.coalesce("_to", "class_id").alias("class_id"))
    return written(found.unionByName(moved.join(labels, "doc_id", "left_anti")), "labels")


def _only(mine: str, theirs: str) -> Column:
    """How many cells the first outline has and the other has not."""
    parts = [(F.get(mine, F.lit(i)), F.get(theirs, F.lit(i))) for i in range(CELLS // 64)]
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in parts])


ONLY_A, ONLY_B = ("outline_a", "outline_b"), ("outline_b", "outline_a")


def may_hold(similarity: float) -> Column:
    """What sizes and outlines of a and b allow.

    A cell that only one document has holds a shingle that only it has, so the cells bound the
    shingles in common from above: what is left out here cannot hold.
    """
    least = (F.col("size_a") + F.col("size_b")) * F.lit(similarity / (1 + similarity)) - 1e-6
    few = F.least("size_a", "size_b") >= least
    return few & (F.col("size_a") - _only(*ONLY_A) >= least) & (F.col("size_b") - _only(*ONLY_B) >= least)


def _side(about: DataFrame, side: str) -> DataFrame:
    """Columns named for one side of a pair, ``doc_id`` for the side itself."""
    return about.select(*[F.col(n).alias({"doc_id": side, "band": "band"}.get(n, f"{n}_{side}")) for n in about.columns])


def classed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose documents are in different classes, with ``class_a`` and ``class_b``."""
    for side in "ab":
        pairs = lookup_join(pairs.drop(f"class_{side}"), labels.toDF(side, f"class_{side}"), [side], "left")
        pairs = pairs.withColumn(f"class_{side}", F.coalesce(f"class_{side}", side))
    return pairs.where("class_a <> class_b")


def candidates(placed: DataFrame, labels: DataFrame, about: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a bucket that are in different classes and may hold, once each: a, b, classes, ``apart``.

    ``apart`` is the number of cells that one of the two has.  In each bucket, a document outside its largest class
    meets all of other classes; the largest class does not meet itself.  Of the buckets that two
    share, the smallest counts.
    """
    own = lookup_join(placed, labels, ["doc_id"], "left").withColumn("class", F.coalesce("class_id", "doc_id")).drop("class_id")
    counts = own.groupBy("band", "class").agg(F.count("*").alias("_size"))
    largest = counts.groupBy("band").agg(F.max(F.struct("_size", "class")).alias("_top"), F.count("*").alias("_classes"))
    own = lookup_join(own, largest.where("_classes > 1"), ["band"], "inner")
    own = own.select("band", "doc_id", "class", (F.col("class") != F.col("_top.class")).alias("minor"))
    own = written(lookup_join(own, about, ["doc_id"], "inner"), "mixed")
    met = _side(own.where("minor"), "a").join(_side(own, "b"), "band")
    met = met.where("class_a <> class_b").where("not minor_b or a < b").where(may_hold(similarity))
    met = met.where(F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band"))
    first = F.col("a") < F.col("b")
    return met.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        F.when(first, F.col("class_a")).otherwise(F.col("class_b")).alias("class_a"),
        F.when(first, F.col("class_b")).otherwise(F.col("class_a")).alias("class_b"),
        (_only(*ONLY_A) + _only(*ONLY_B)).alias("apart"),
    )


def nearest(pairs: DataFrame) -> DataFrame:
    """For each class the pair with the fewest cells apart that leads out of it: no more pairs than classes."""
    pair = F.struct("apart", "a", "b")
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class"), pair.alias("pair"))
    return ends.groupBy("class").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: int = WEIGHTED_BANDS
) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of the class), class_size, kept.

    kept is true for rows whose doc_id is the class_id.
    Needs doc_id and text; other columns are ignored.  Texts without words (null, empty, blank) are classes of
    their own, as are rows without doc_id (class_id null, kept).  Rows of equal doc_id
    share a class only if their words make them; their class is the smaller one.
    An empty table gives no rows.
    """
    ready(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketches = written(sketch(given, bands, rows, weighted), "sketches")
    worded = sketches.where((F.size("bands") > 0) & F.col("doc_id").isNotNull())
    contents = worded.groupBy("content_a", "content_b").agg(F.min("doc_id").alias("rep"))
    columns = [F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("bands", "size", "outline")]
    members = written(lookup_join(worded, contents, ["content_a", "content_b"], "inner").select("doc_id", "rep", *columns), "contents")

    # one row for each distinct text; of equal doc_ids with other texts one is tried
    about = members.where(F.col("bands").isNotNull()).select("doc_id", "bands", "size", "outline").dropDuplicates(["doc_id"])
    in_bands = about.select("doc_id", F.explode("bands").alias("band"))
    firsts = in_bands.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("_size")).where("_size > 1").drop("_size")
    placed = written(lookup_join(in_bands, firsts, ["band"], "inner"), "buckets")
    met = placed.select("doc_id").distinct()
    about = written(lookup_join(about, met, ["doc_id"], "inner"), "met")
    texts = written(given.join(about.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        return written(verified(pairs, texts, similarity), "held")

    stars = placed.where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    for side in "ab":
        stars = lookup_join(stars, _side(about.select("doc_id", "size", "outline"), side), [side], "inner")
    stars = stars.where(may_hold(similarity)).select("b", F.struct((_only(*ONLY_A) + _only(*ONLY_B)).alias("apart"), "a").alias("star"))
    held = verify(written(stars.groupBy("b").agg(F.min("star").alias("star")).select("star.a", "b"), "stars"))
    labels = rooted(held.select(F.col("b").alias("doc_id"), F.col("a").alias("parent")))

    left = written(candidates(placed.select("band", "doc_id"), labels, about, similarity), "candidates")
    for last in [False] * ROUNDS + [True]:
        if left.isEmpty():
            break
        turn = left.select("a", "b") if last else written(nearest(left), "turn")
        ties = classed(verify(turn), labels).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        labels = relabelled(labels, components(ties))
        if not last:
            left = written(classed(left.join(turn, ["a", "b"], "left_anti"), labels), "candidates")

    told = lookup_join(members.select("doc_id", "rep"), labels.withColumnRenamed("doc_id", "rep"), ["rep"], "left")
    told = told.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"))
    sizes = told.groupBy("class_id").agg(F.count("*").alias("class_size"))
    told = lookup_join(told, sizes, ["class_id"], "inner")
    apart = sketches.where((F.size("bands") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size")
    )
    names = ["doc_id", "class_id", "class_size"]
    return told.select(*names).union(apart.select(*names)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
