"""BPE as a deterministic automaton over tokens, built by successive merge gadgets.

The automaton reads tokens; its state says which token may come next, so that the one
path whose labels spell a word is the word's encoding.  It starts with one state for
each single byte and every token allowed everywhere.  Merge ``k`` of ``u`` and ``v`` into
``w`` puts in its gadget:

* where ``u`` may come and then ``v``, an arc ``w`` may come too;
* the state after ``w`` has the arcs that the state after ``v`` has at that time;
* the state after ``u`` loses its arc ``v``.

(With ``u = v`` there is no ``w`` straight after a lone ``u``: merging goes left to right.)
Equal states are one row of the finished table.  Words are split off before encoding
and each distinct word runs through the table once for each worker; decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from stackroom.llm.common import ready

WORD_END = "</w>"
CACHED_WORDS = 500_000
NEVER = np.iinfo(np.int32).max

# How the vocabulary splits words.
ASCII_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Automaton:
    """Tables of the automaton: a row of allowed tokens (bits) for each state, a state for each token."""

    def __init__(self, allowed: np.ndarray, state_of: np.ndarray, labels: list[str], special: dict[str, int], path: str):
        self.allowed, self.state_of, self.labels, self.special, self.path = allowed, state_of, labels, special, path
        symbols = byte_symbols()
        byte_of = {c: bytes([b]) for b, c in enumerate(symbols)}
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for token, label in enumerate(labels):
            if label is None or label in special:
                continue
            ends = label.endswith(WORD_END)
            spelled = b"".join(byte_of[c] for c in (label[: -len(WORD_END)] if ends else label))
            (self.last if ends else self.inner)[spelled] = token
        self.longest = max(map(len, [*self.inner, *self.last]))
        self._byte_of = byte_of
        self._splitter = None
        self._marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __getstate__(self):
        return self.allowed, self.state_of, self.labels, self.special, self.path

    def __setstate__(self, state):
        self.__init__(*state)

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the only path that spells the word, found prefix by prefix."""
        n = len(word)
        token, back, state = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        allowed, state_of = self.allowed, self.state_of
        for end in range(1, n + 1):
            arcs = self.last if end == n else self.inner
            for start in range(max(0, end - self.longest), end):
                t = arcs.get(word[start:end])
                if t is None:
                    continue
                s = state[start]
                if start == 0 or (s >= 0 and allowed[s, t >> 3] >> (7 - (t & 7)) & 1):
                    token[end], back[end], state[end] = t, start, state_of[t]
                    break
        out, end = [], n
        while end:
            out.append(token[end])
            end = back[end]
        return out[::-1]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and marks that are one token each."""
        if self._marks is None or not any(mark in text for mark in self.special):
            yield text, False
            return
        for i, part in enumerate(self._marks.split(text)):
            if part:
                yield part, bool(i % 2)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in set(text) if c > "\u0500"):
            return self._newer_words(text)
        # letter by letter, without the special form of a sigma at a word's end
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _newer_words(self, text: str) -> list[str]:
        """Words of a text with letters that this Python's Unicode tables lack, split by the library."""
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path)
        text = self._splitter.normalizer.normalize_str(text)
        shown = [word for word, _ in self._splitter.pre_tokenizer.pre_tokenize_str(text)]
        return [b"".join(self._byte_of[c] for c in word).decode() for word in shown]


class WordIds(dict):
    """Encoded ids of words, as bytes; filled on demand, emptied when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self._automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = np.array(self._automaton.encode_word(word.encode()), "<u4").tobytes()
        self[word] = ids
        return ids


def compile_automaton(path: str | None = None) -> Automaton:
    """Read a vocabulary file and put in one gadget for each merge, in their order."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    vocab = stored["model"]["vocab"]
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    labels: list = [None] * size
    for label, token in [*vocab.items(), *special.items()]:
        labels[token] = label

    born = np.full(size, -1, np.int32)  # by which merge
    left = np.full(size, -1, np.int64)
    right = np.full(size, -1, np.int64)
    level = np.zeros(size, np.int64)
    closed_by: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    order = []
    for k, merge in enumerate(stored["model"]["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        u, v, w = vocab[a], vocab[b], vocab[a + b]
        born[w], left[w], right[w], level[w] = k, u, v, level[u] + 1
        closed_by[u].append((v, k))
        order.append(w)
    made = np.array(order, np.int64)
    by_level = [made[level[made] == n] for n in range(1, int(level.max()) + 1)]
    times = [born[tokens] for tokens in by_level]

    # tokens that end a word have no state: nothing follows them
    single = [t for t in range(size) if born[t] < 0 and labels[t] is not None and labels[t] not in special]
    inner = [t for t in [*single, *order] if not labels[t].endswith(WORD_END)]
    rows: dict[bytes, int] = {}
    state_of = np.full(size, -1, np.int32)
    stored_rows: dict[int, np.ndarray] = {}
    final: list[np.ndarray] = []
    for x in inner:
        k = born[x]
        if k < 0:
            row = np.zeros(size, bool)
            row[single] = True
        else:
            r = int(right[x])
            row = np.unpackbits(stored_rows[r], count=size).astype(bool)
            for y, t in closed_by[r]:
                if t >= k:  # still open when x was made
                    row[y] = True
            row[x] = row[left[x]]
            row[born > k] = False
        own = {y: t for y, t in closed_by[x]}
        # an arc that is closed at time t still passes on to what was made before t
        closing = np.full(size, NEVER, np.int32)
        for y, t in own.items():
            closing[y] = t
        for tokens, at in zip(by_level, times):
            since = np.searchsorted(at, k, side="right")
            later, when = tokens[since:], at[since:]
            base = left[later]
            row[later] = row[base] & (closing[base] > when)
        for y in own:
            row[y] = False
        packed = np.packbits(row)
        key = packed.tobytes()
        if key not in rows:
            rows[key] = len(final)
            final.append(packed)
        state_of[x] = rows[key]
        stored_rows[x] = final[rows[key]]
    return Automaton(np.stack(final), state_of, labels, special, path)


_compiled: dict[str | None, Automaton] = {}


def automaton(path: str | None = None) -> Automaton:
    if path not in _compiled:
        _compiled[path] = compile_automaton(path)
    return _compiled[path]


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, vocabulary: str | None = None, keep: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again, and give both as digests (with ``keep`` also as such).

    Needs doc_id and text; other columns are ignored, whatever their names.  One row
    for each input row, repeated or not; null and empty texts have no ids and decode
    to the empty text; a null doc_id stays null; an empty table gives no rows.  Marks
    of the vocabulary (start, end of text) inside a text are their own ids.
    """
    # its size follows from the vocabulary alone, so it goes to every worker
    shared = ready(docs.sparkSession).sparkContext.broadcast(automaton(vocabulary))
    shape = ENCODED + (", ids array<int>, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Automaton = shared.value
        known = WordIds(machine)
        labels = machine.labels
        marks = {mark: np.array([i], "<u4").tobytes() for mark, i in machine.special.items()}
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep
        names = [part.split()[0] for part in shape.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = []
                for part, mark in machine.parts(text.as_py() or ""):
                    if mark:
                        found.append(marks[part])
                    else:
                        found.extend(map(known.__getitem__, machine.words(part)))
                raw = b"".join(found)
                ids = np.frombuffer(raw, "<u4").tolist()
                decoded = " ".join(map(labels.__getitem__, ids))
                row = [doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                for column, value in zip(out, row + [ids, decoded] * keep):
                    column.append(value)
            arrays = [pa.array(column, kind) for column, kind in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, shape)
