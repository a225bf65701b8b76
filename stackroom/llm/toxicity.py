"""Toxicity by a weighted finite-state grammar over clauses.

Transducers are tables of arcs (state, symbol) -> (state, weight).  A lexicon reads words
and gives symbols: insults, with the strength that was learned for the word or
its stem, threats, targets, negations, reports, other words, ends of clauses.  Each
rule of the grammar is a transducer over these symbols; their composition reads a
clause once and adds up weights: an insult counts, more so beside a target; a threat
counts with a target; after a negation or inside a report it counts less.  Documents are
scored by their matched clauses, not by single words.

Words and stems are weighed on a bounded sample of labelled rows, in two halves: the grammar
of one half scores the other, and a logistic curve is fitted to those scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackroom.llm.common import ready, shape_of, together, written

SAMPLE_ROWS = 30_000  # labelled rows learned from, about
LEXICON_ENTRIES = 20_000
LEAST_TEXTS = 3  # toxic texts that an entry occurs in
LEAST_WEIGHT = 3.0  # log odds
STEMS = (3, 4, 5, 6)
CACHED_WORDS = 300_000
FLUSH = 400_000

# Symbols: ends of clauses, insults by strength, then the rest.
END, INSULT_1, INSULT_2, INSULT_3, INSULT_4, THREAT, TARGET, NEGATION, REPORT, OTHER = range(10)
INSULTS = (INSULT_1, INSULT_2, INSULT_3, INSULT_4)
STRENGTHS = (3.0, 4.5, 6.0, 7.5)

# Closed-class words of the grammar.
CLOSED = {
    THREAT: "kill hurt destroy burn hang shoot beat stab töten verletzen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours they them their he she him her people du ihr euch dein euer tu toi vous votre ils elles tú usted ustedes vosotros ellos ellas",
    NEGATION: "not never no isn aren don doesn didn without nicht nie kein keine ohne ne pas jamais sans nunca jamás sin",
    REPORT: "said says called wrote quoted reported told claimed sagte schrieb berichtete dit écrit rapporté dijo escribió llamó",
}
TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")


@dataclass
class Transducer:
    """Deterministic and complete: ``step[state][symbol]`` and the weight taken on the way."""

    step: list[list[int]]
    weight: list[list[float]]

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both read the same symbols side by side; the weight of one scales that of the other."""
        pairs, todo = {(0, 0): 0}, [(0, 0)]
        step, weight = [], []
        for a, b in todo:
            row, gains = [], []
            for symbol in range(len(self.step[a])):
                to = (self.step[a][symbol], other.step[b][symbol])
                if to not in pairs:
                    pairs[to] = len(todo)
                    todo.append(to)
                row.append(pairs[to])
                gains.append(self.weight[a][symbol] * other.weight[b][symbol])
            step.append(row)
            weight.append(gains)
        return Transducer(step, weight)


def window(opens: tuple[int, ...], affects: tuple[int, ...], inside: float, outside: float, reach: int) -> Transducer:
    """Scale the weight of ``affects`` by ``inside`` for ``reach`` symbols after one of ``opens``, else by ``outside``."""
    symbols = range(OTHER + 1)
    step = [
        [reach if s in opens else 0 if s == END else max(0, state - 1) for s in symbols] for state in range(reach + 1)
    ]
    weight = [[(inside if state else outside) if s in affects else 1.0 for s in symbols] for state in range(reach + 1)]
    return Transducer(step, weight)


def grammar() -> Transducer:
    worth = {**dict(zip(INSULTS, STRENGTHS)), THREAT: 6.0}
    base = Transducer([[0] * (OTHER + 1)], [[worth.get(s, 0.0) for s in range(OTHER + 1)]])
    insult_at_target = window((TARGET,), INSULTS, 1.25, 1.0, 4)
    threat_at_target = window((TARGET,), (THREAT,), 1.0, 0.0, 6)
    threat_beside_insult = window(INSULTS, (THREAT,), 1.25, 1.0, 6)
    negated = window((NEGATION,), (*INSULTS, THREAT), 0.6, 1.0, 3)
    reported = window((REPORT,), (*INSULTS, THREAT), 0.7, 1.0, 40)
    return base @ insult_at_target @ threat_at_target @ threat_beside_insult @ negated @ reported


class Lexicon(dict):
    """Symbol of a word; filled on demand, emptied when full."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self._entries = entries
        self._closed = {word: symbol for symbol, words in CLOSED.items() for word in words.split()}
        self._closed |= dict.fromkeys(".!?;:\n", END)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = symbol = self._look_up(word)
        return symbol

    def _look_up(self, word: str) -> int:
        if word in self._closed:
            return self._closed[word]
        found = [self._entries[key] for key in keys(word) if key in self._entries]
        if not found:
            return OTHER
        return INSULTS[int(np.searchsorted(STRENGTHS, max(found), side="right")) - 1]


def keys(word: str) -> list[str]:
    """A word and its stems, which end in a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Machine:
    """Lexicon and grammar: from a text to what its clauses weigh."""

    def __init__(self, entries: dict[str, float]):
        self._lexicon = Lexicon(entries)
        self._grammar = grammar()

    def __call__(self, text: str | None) -> list[float]:
        """Sum and maximum of clause weights, matched clauses, and the sum for each root of the length."""
        symbols = bytes(map(self._lexicon.__getitem__, TOKENS.findall((text or "").lower())))
        step, weight = self._grammar.step, self._grammar.weight
        total = most = count = 0.0
        for clause in symbols.split(bytes([END])):
            if not any(s in clause for s in (*INSULTS, THREAT)):
                continue
            state, gained = 0, 0.0
            for symbol in clause:
                gained += weight[state][symbol]
                state = step[state][symbol]
            if gained:
                total, most, count = total + gained, max(most, gained), count + 1
        return [math.log1p(total), math.log1p(most), math.log1p(count), total / math.sqrt(len(symbols) + 20.0)]


COUNTED = "entry string, toxic_0 bigint, clean_0 bigint, toxic_1 bigint, clean_1 bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic, half): in how many texts of each kind an entry occurs, summed up here first."""
    counts = [Counter() for _ in range(4)]

    def out():
        names = [part.split()[0] for part in COUNTED.split(", ")]
        entries = list(set().union(*counts))
        columns = [pa.array(entries, pa.string())] + [pa.array([c[e] for e in entries], pa.int64()) for c in counts]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
            words = set(TOKENS.findall((text or "").lower()))
            counts[2 * half + (0 if toxic else 1)].update({key for word in words for key in keys(word)})
            if sum(map(len, counts)) > FLUSH:
                yield out()
    yield out()


def _entries(rows: list, halves: tuple[int, ...], totals: np.ndarray) -> dict[str, float]:
    toxic_all, clean_all = totals[list(halves), 1].sum(), totals[list(halves), 0].sum()
    found = {}
    for row in rows:
        toxic = sum(row[f"toxic_{h}"] for h in halves)
        clean = sum(row[f"clean_{h}"] for h in halves)
        if toxic >= LEAST_TEXTS:
            odds = math.log((toxic + 0.5) / (toxic_all + 1)) - math.log((clean + 0.5) / (clean_all + 1))
            if odds >= LEAST_WEIGHT:
                found[row["entry"]] = odds
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and a last intercept by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(curve, slope)
        beta = beta + change
        if np.abs(change).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    entries: dict[str, float]
    curve: np.ndarray


def learn(texts: DataFrame) -> Model:
    """From the rows (doc_id, text, toxic) of a bounded sample.

    The driver gets counts of at most ``LEXICON_ENTRIES`` words and stems and four numbers for
    each row of the sample.  Without rows of both kinds every score is the share of toxic ones.
    """
    spark = texts.sparkSession
    sample = texts.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    kinds = sample.groupBy("half", "toxic").count().collect()
    totals = np.zeros((2, 2))
    for row in kinds:
        totals[row.half, row.toxic] += row["count"]
    if not totals.sum(axis=0).all():
        share = float(totals[:, 1].sum() / max(1.0, totals.sum()))
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, np.array([0, 0, 0, 0, math.log(share / (1 - share))]))
    counted = sample.select("text", "toxic", "half").mapInArrow(_count, COUNTED).groupBy("entry")
    counted = counted.agg(*(F.sum(c).alias(c) for c in ("toxic_0", "clean_0", "toxic_1", "clean_1")))
    toxic, clean = F.col("toxic_0") + F.col("toxic_1"), F.col("clean_0") + F.col("clean_1")
    odds = F.log((toxic + 0.5) / (clean + 0.5))
    base = math.log((totals[:, 1].sum() + 1) / (totals[:, 0].sum() + 1))
    # each half may see an entry as stronger than both together do
    useful = counted.where((toxic >= LEAST_TEXTS) & (odds >= base + LEAST_WEIGHT - 1))
    rows = useful.orderBy(F.desc(toxic), "entry").limit(LEXICON_ENTRIES).collect()
    halves = [_entries(rows, (1 - h,), totals) for h in (0, 1)]
    shared = spark.sparkContext.broadcast(halves)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Machine(entries) for entries in shared.value]
        for batch in batches:
            values = [[*machines[half](text), float(toxic)] for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64()))], names=["values"])

    described = sample.select("text", "toxic", "half").mapInArrow(describe, "values array<double>").collect()
    table = np.array([row[0] for row in described])
    return Model(_entries(rows, (0, 1), totals), fit_logistic(table[:, :4], table[:, 4]))


SCORED = "score double, predicted int"
THRESHOLD = 0.7


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row, score (0 to 1) and predicted.

    Only text is looked at; null counts as empty, and a text without matched clauses
    has the least score.  One row for each input row; an empty table gives none.
    """
    # bounded by LEXICON_ENTRIES
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, curve = Machine(shared.value.entries), shared.value.curve
        for batch in batches:
            values = np.array([machine(text.as_py()) for text in batch.column("_text")]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(values @ curve[:4] + curve[4], -30, 30)))
            columns = [batch.column("given"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["given", "score", "predicted"])

    given, back = together(keep, SCORED)
    rows = docs.select(given, F.col("text").cast("string").alias("_text"))
    told = rows.mapInArrow(run, shape_of(rows, SCORED))
    return told.select(*back, *[part.split()[0] for part in SCORED.split(", ")])


def held_out(parts: int = 3, part: int = 1):
    """Whether a row is kept from learning, by its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """Rows (doc_id, text, label) that are not held out, about ``sample_rows`` chosen by a hash.

    Of repeated labels of a document the larger counts; labels that are null teach nothing.
    """
    usable = labels.where(~held_out() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    usable = usable.agg(F.max(F.col(label).cast("int")).alias(label))
    share = sample_rows / max(1, usable.count())
    draw = F.xxhash64("doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    # its size is bounded by ``sample_rows``
    chosen = F.broadcast(usable.where(draw < share))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(chosen, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on)."""
    ready(docs.sparkSession)
    # read several times, so written: the texts are looked through once for it
    model = learn(written(labelled_sample(docs, labels, "toxic", sample_rows), "labelled-texts"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
