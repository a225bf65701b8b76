"""Quality by co-training: a view of the text's content and a view of the page's metadata.

Each view has its own logistic classifier.  In each round either classifier labels the
pool rows it is surest of, in the proportion of the known labels, for the *other* one to learn
from.  After the last round both views are calibrated on labelled rows that neither
learned from, and combined into one score for every document.

The features of all texts are computed once and written; only a bounded sample of their
rows, labelled and not, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackroom.llm.arrays import pieces, split_words, text_bytes
from stackroom.llm.common import ready, written
from stackroom.llm.toxicity import fit_logistic, held_out
from stackroom.operators.skew import lookup_join

SAMPLE_ROWS = 20_000  # labelled rows, about, and as many pool rows
ROUNDS = 5
SHARE = 0.02  # of the pool that each view labels in a round
THRESHOLD = 0.5
RIDGE = 1.0  # of the last combination, whose rows may be few and separable
CHECKS = 3  # one labelled row in so many only calibrates
BUCKETS = 16  # of a hash of source, and of lang

# Byte classes: upper case, digits, line ends, bars, sentence ends, other marks of ASCII.
UPPER, DIGIT, LINE, BAR, STOP, MARK, MULTI = (np.zeros(256, bool) for _ in range(7))
UPPER[65:91] = DIGIT[48:58] = MULTI[128:] = True
LINE[10], BAR[124] = True, True
STOP[list(b".!?")] = True
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
MARK[list(b".,'-|")] = False


def _per_text(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marked)))[at]).astype(np.float64)


def content_view(column: pa.Array) -> np.ndarray:
    """Of each text: words and their lengths, repetition, and shares of byte classes."""
    data, at = text_bytes(column)
    words = split_words(column)
    n = np.maximum(words.counts, 1).astype(np.float64)
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    owner = words.owner()
    order = np.lexsort((words.hash, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    of = owner[order][first]
    distinct = np.bincount(of, minlength=len(n))
    most = np.zeros(len(n))
    np.maximum.at(most, of, counts)
    again = np.zeros(len(owner), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    letters = np.bincount(owner, weights=(words.end - words.start), minlength=len(n))
    long_words = np.bincount(owner, weights=(words.end - words.start) > 20, minlength=len(n))
    shares = [_per_text(kind[data], at) / size for kind in (UPPER, DIGIT, BAR, STOP, MARK, MULTI)]
    return np.column_stack(
        [np.log1p(words.counts), letters / n, distinct / n, most / n, np.bincount(owner, weights=again, minlength=len(n)) / n, long_words / n, *shares]
    )


def metadata_view(column: pa.Array, chars: np.ndarray, lang: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each page: stated size, layout of lines, and buckets of language and source."""
    data, at = text_bytes(column)
    lines = _per_text(LINE[data], at) + 1
    before = np.zeros(len(data), bool)
    before[:-1] = STOP[data[:-1]] & LINE[data[1:]]
    closed = _per_text(before, at)
    one_hot = np.zeros((len(lines), 2 * BUCKETS))
    one_hot[np.arange(len(lines)), lang] = 1
    one_hot[np.arange(len(lines)), BUCKETS + source] = 1
    size = np.log1p(np.maximum(np.nan_to_num(chars), 0))
    return np.column_stack([size, np.log1p(lines), size - np.log1p(lines), closed / lines, np.isnan(chars), one_hot])


VIEWS = "doc_id bigint, content array<double>, metadata array<double>"


def views(docs: DataFrame) -> DataFrame:
    """Features of every row's text and metadata; nulls count as empty text, unknown size, a bucket of their own."""
    bucket = lambda c: F.pmod(F.coalesce(F.xxhash64(F.col(c).cast("string")), F.lit(0)), F.lit(BUCKETS)).alias(c)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("n_chars").cast("double").alias("chars"),
        bucket("lang"),
        bucket("source"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                chars = part.column("chars").to_numpy(zero_copy_only=False).astype(np.float64)
                lang, source = (part.column(c).to_numpy() for c in ("lang", "source"))
                found = [content_view(part.column("text")), metadata_view(part.column("text"), chars, lang, source)]
                lists = [
                    pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())) for x in found
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "content", "metadata"])

    return rows.mapInArrow(run, VIEWS)


@dataclass
class Model:
    """For each view: mean and scale of its features, and weights; then what combines the two."""

    centre: list[np.ndarray]
    scale: list[np.ndarray]
    weights: list[np.ndarray]
    combine: np.ndarray

    def logits(self, view: int, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre[view]) / self.scale[view], -8, 8)
        return np.clip(z @ self.weights[view][:-1] + self.weights[view][-1], -30, 30)

    def __call__(self, views: list[np.ndarray]) -> np.ndarray:
        both = np.column_stack([self.logits(v, x) for v, x in enumerate(views)])
        return 1 / (1 + np.exp(-np.clip(both @ self.combine[:2] + self.combine[2], -30, 30)))


def co_train(
    known: list[np.ndarray],
    label: np.ndarray,
    pool: list[np.ndarray],
    rounds: int = ROUNDS,
    share: float = SHARE,
    checks: np.ndarray | None = None,
) -> Model:
    """``checks`` marks the labelled rows that only calibrate: every third, if not given.

    With labels of one kind all scores are their share.  Of pool rows that a view is equally sure of,
    the first in order is labelled; so rows in the same order give the same model.
    """
    known = [x.reshape(len(label), -1) if len(label) else np.zeros((0, 1)) for x in known]
    if len(set(label.tolist())) < 2 or len(label) < 6:
        rate = (label.sum() + 1) / (len(label) + 2)
        sizes = [x.shape[1] if x.ndim == 2 else 1 for x in (known if len(label) else pool)]
        return Model([np.zeros(n) for n in sizes], [np.ones(n) for n in sizes], [np.zeros(n + 1) for n in sizes], np.array([0, 0, np.log(rate / (1 - rate))]))
    model = Model([x.mean(axis=0) for x in known], [x.std(axis=0) + 1e-6 for x in known], [], np.array([0.5, 0.5, 0]))
    if checks is None or not 0 < checks.sum() < len(label) or len(set(label[~checks].tolist())) < 2:
        checks = np.arange(len(label)) % 3 == 2
    rate = label.mean()
    lessons = [([x[~checks]], [label[~checks]]) for x in known]
    unused = [np.ones(len(pool[0]), bool) for _ in known]
    for turn in range(rounds + 1):
        model.weights = [
            fit_logistic(np.clip((np.concatenate(x) - model.centre[v]) / model.scale[v], -8, 8), np.concatenate(y))
            for v, (x, y) in enumerate(lessons)
        ]
        if turn == rounds or not len(pool[0]):
            break
        for teacher, student in ((0, 1), (1, 0)):
            told = model.logits(teacher, pool[teacher])
            order = np.argsort(told, kind="stable")
            order = order[unused[student][order]]
            n = int(len(told) * share)
            best = np.argsort(-told, kind="stable")
            good, bad = best[unused[student][best]][: int(n * rate)], order[: n - int(n * rate)]
            for rows, value in ((good, 1.0), (bad, 0.0)):
                sure = rows[(told[rows] > 2) if value else (told[rows] < -2)]  # odds of 7 to 1
                lessons[student][0].append(pool[student][sure])
                lessons[student][1].append(np.full(len(sure), value))
                unused[student][sure] = False
    both = np.column_stack([model.logits(v, x[checks]) for v, x in enumerate(known)])
    model.combine = fit_logistic(both, label[checks], ridge=RIDGE)
    return model


SCORED = "doc_id bigint, score double, predicted int"
NAMES = ("content", "metadata")


def _drawn(rows: DataFrame, salt: str, limit: float) -> DataFrame:
    """Rows whose doc_id draws a number below ``limit``, the same in every run."""
    return rows.where(F.xxhash64("doc_id", F.lit(salt)).bitwiseAND((1 << 52) - 1) / float(1 << 52) < limit)


def _collected(rows: DataFrame, *others: str) -> tuple[list[np.ndarray], np.ndarray]:
    """A bounded sample in an order of its own, whatever the partitions: by doc_id, then by all values."""
    frame = rows.select("doc_id", *NAMES, *others).toPandas()
    views = [np.array(frame[name].tolist(), np.float64) if len(frame) else np.zeros((0, 1)) for name in NAMES]
    rest = frame[["doc_id", *others]].astype(np.float64).fillna(-np.inf).to_numpy()
    columns = np.column_stack([*views, rest[:, 1:], rest[:, :1]])
    order = np.lexsort(columns.T) if len(frame) else np.zeros(0, int)
    return [x[order] for x in views], rest[order, 1:]


def train(found: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the views ``found`` and of labels: a function of their rows alone, in any order and partitioning."""
    usable = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    usable = usable.agg(F.max(F.col("quality").cast("double")).alias("label"))
    chosen = _drawn(usable, "known", sample_rows / max(1, usable.count()))
    checks = (F.pmod(F.xxhash64("doc_id", F.lit("checks")), F.lit(CHECKS)) == 0).cast("double").alias("checks")
    taught, told = _collected(lookup_join(found, chosen, ["doc_id"], "inner").select("*", checks), "label", "checks")
    pool, _ = _collected(_drawn(found, "pool", sample_rows / max(1, found.count())))
    return co_train(taught, told[:, 0], pool, checks=told[:, 1] == 1)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (1: good), predicted (1 from ``THRESHOLD`` on).

    Learns quality from rows whose crc32(doc_id as text) mod 3 is not 1, and from about as many
    pool rows without their labels; ``sample_rows`` bounds both.  Which rows teach, calibrate or are in the
    pool is told from their doc_id.  Needs doc_id, text, lang,
    source and n_chars, which may all be null; null labels teach nothing, of repeated ones
    the larger counts.  An empty table gives no rows.
    """
    ready(docs.sparkSession)
    found = written(views(docs), "views")
    model = train(found, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = shared.value([batch.column(n).flatten().to_numpy().reshape(batch.num_rows, -1) for n in NAMES])
            columns = [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return found.mapInArrow(run, SCORED).select("doc_id", held_out().alias("held_out"), "score", "predicted")
