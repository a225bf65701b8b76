"""Piece encoding by merge order, found without merging whole texts: longest matches and backtracking.

The vocabulary has no list of merges: two neighbours merge where their join is a piece, pieces
of higher score first, from left to right.  A sequence of pieces is the encoding of its text
exactly if each piece comes out of its own characters and each two neighbours come out of
theirs, since a merge over a boundary would show in those two alone.  So the encoder walks
from left to right with the longest piece at each place, as an Aho-Corasick automaton found
it; where a piece does not go with the one before (their characters, merged again, give
something else), or ends where the rest is known to fail, it takes the next shorter piece;
where none is left it marks the place as failed, in a field of bits, and takes back a piece.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackroom.llm.common import ready

SPACE = "▁"
CACHED_PARTS, CACHED_PAIRS, CACHED_LENGTH = 400_000, 400_000, 64
CHUNK = 1 << 18  # characters encoded at a time, up to the next space
NEVER = float("-inf")
BROKEN = "�"

# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6
BPE = 2


class Vocabulary:
    """Pieces, scores and bytes of a model file.

    What texts are turned into before encoding is fixed: spaces become a mark of their own,
    and one is put in front; models that ask for anything else are refused.
    """

    def __init__(self, path: str | None = None):
        from sentencepiece import sentencepiece_model_pb2

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        asked = (spec.add_dummy_prefix, spec.escape_whitespaces, trained.byte_fallback, trained.model_type == BPE)
        other = (spec.remove_extra_whitespaces, spec.precompiled_charsmap, trained.treat_whitespace_as_suffix)
        if not all(asked) or any(other) or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"not a plain merge vocabulary with bytes: {path}")
        self.scores: dict[str, float] = {}
        self.id_of: dict[str, str] = {}
        self.raw: list[bytes] = []
        self.byte_id = [""] * 256
        self.of_bytes = set()
        for i, piece in enumerate(model.pieces):
            raw = b""
            if piece.type == NORMAL:
                self.scores[piece.piece] = piece.score
                self.id_of[piece.piece] = str(i)
                raw = piece.piece.replace(SPACE, " ").encode()
            elif piece.type == BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_id[value] = str(i)
                self.of_bytes.add(i)
                raw = bytes([value])
            elif piece.type == UNKNOWN:
                raw = trained.unk_surface.encode()
            self.raw.append(raw)
        # what is left single without a piece of its own is spelled in bytes
        self.alphabet = sorted({c for piece in self.scores for c in piece} | {SPACE})
        self.single = {c for c in self.alphabet if c not in self.scores}
        self.tokens = [w for w in self.scores if self.merged(w) == [w]] + sorted(self.single)

    def merged(self, characters: str, edge: int = 0) -> list[str] | None:
        """Pieces that merging gives, best score first, leftmost of equal ones first.

        None as soon as a merge goes over the place ``edge``, if that is given.
        """
        parts = list(characters)
        score = self.scores.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            if edge and sum(map(len, parts[: at + 1])) == edge:
                return None
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joined]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + joined, NEVER)
            if at < len(scores):
                scores[at] = score(joined + parts[at + 1], NEVER)
        return parts

    def spelled(self, token: str) -> str:
        """Its id, or the ids of its bytes."""
        return self.id_of.get(token) or ",".join(self.byte_id[b] for b in token.encode())


def separate(vocabulary: Vocabulary) -> tuple[re.Pattern, re.Pattern | None]:
    """Patterns of parts that are encoded on their own, and of places where a text can be cut.

    Letters that stand beside each other in some piece are of one kind; no merge goes over
    a change of kind.  Spaces go with what follows, if no piece has one behind anything else.
    """
    known = "".join(map(re.escape, vocabulary.alphabet))
    if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in vocabulary.scores):
        return re.compile(f"[{known}]+|[^{known}]+"), None
    kind = {letter: {letter} for letter in vocabulary.alphabet}
    for piece in vocabulary.scores:
        letters = piece.lstrip(SPACE)
        for a, b in zip(letters, letters[1:]):
            if kind[a] is not kind[b]:
                more, less = sorted((kind[a], kind[b]), key=len, reverse=True)
                more |= less
                kind.update(dict.fromkeys(less, more))
    kinds = {id(letters): letters for letter, letters in kind.items() if letter != SPACE}.values()
    alone = "".join(re.escape(c) for letters in kinds if len(letters) == 1 for c in letters)
    runs = ["".join(map(re.escape, sorted(letters))) for letters in kinds if len(letters) > 1]
    runs.sort(key=len, reverse=True)
    parts = [f"{SPACE}*[{run}]+" for run in runs] + [f"{SPACE}*[{alone}]"] * bool(alone)
    return re.compile("|".join([*parts, f"{SPACE}+", f"[^{known}]+"])), re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Encoder:
    """Encodes and decodes; keeps what it found out about parts and pairs, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        self._matches = ahocorasick.Automaton()
        known = set(vocabulary.tokens)
        self._shorter: dict[str, str | None] = {}
        for token in vocabulary.tokens:
            self._matches.add_word(token, token)
            lengths = range(len(token) - 1, 0, -1)
            self._shorter[token] = next((token[:k] for k in lengths if token[:k] in known), None)
        self._matches.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._parts: dict[str, str] = {}
        self._raw = {str(i): raw for i, raw in enumerate(vocabulary.raw)}
        self._spaced = {i for piece, i in vocabulary.id_of.items() if piece.startswith(SPACE)}
        self._bytes = {str(i) for i in vocabulary.of_bytes}
        self._letters = set(vocabulary.alphabet)
        self._split, self._cut = separate(vocabulary)

    def goes_before(self, left: str, right: str) -> bool:
        """Whether the characters of both, merged again, give just these two."""
        pair = (left, right)
        found = self._pairs.get(pair)
        if found is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            found = self._pairs[pair] = self._vocabulary.merged(left + right, len(left)) == [left, right]
        return found

    def tokens(self, part: str) -> list[str]:
        """Pieces of characters of the alphabet, by backtracking over longest matches."""
        longest: list[str | None] = [None] * len(part)
        for end, token in self._matches.iter(part):
            longest[end - len(token) + 1] = token  # ends ascend: what comes later from one place is longer
        failed = bytearray((len(part) >> 3) + 1)
        taken: list[str] = []
        at, token = 0, longest[0]
        while at < len(part):
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (not taken or self.goes_before(taken[-1], token)):
                    break
                token = self._shorter[token]
            if token is not None:
                taken.append(token)
                at += len(token)
                token = longest[at] if at < len(part) else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = taken.pop()
                at -= len(token)
        return taken

    def _ids(self, part: str) -> str:
        found = self._parts.get(part)
        if found is None:
            tokens = self.tokens(part) if part[0] in self._letters else part
            found = ",".join(map(self._vocabulary.spelled, tokens))
            if len(part) <= CACHED_LENGTH:
                if len(self._parts) >= CACHED_PARTS:
                    self._parts.clear()
                self._parts[part] = found
        return found

    def encode(self, text: str) -> Iterator[str]:
        """Decimal ids joined by commas, chunk by chunk of the text."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        at = 0
        while at < len(text):
            end = len(text)
            if self._cut is not None and at + CHUNK < end:
                place = self._cut.search(text, at + CHUNK)
                end = place.start() if place else end
            yield ",".join(map(self._ids, self._split.findall(text, at, end)))
            at = end

    def decode(self, chunks: Iterator[str]) -> Iterator[str]:
        """The text of ids in order; a space in front of everything was put in by encoding and goes."""
        shown = False
        for chunk in chunks:
            ids = chunk.split(",")
            raw = b"".join(map(self._raw.__getitem__, ids))
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = self._mended(ids)
            if not shown and raw:
                shown = True
                first = next(i for i in ids if self._raw[i])
                text = text[first in self._spaced :]
            yield text

    def _mended(self, ids: list[str]) -> str:
        """Bytes that are no character give a mark each."""
        out, run = [], b""
        for i in [*ids, None]:
            if i in self._bytes:
                run += self._raw[i]
                continue
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(BROKEN)
                    n = 1
                run = run[n:]
            if i is not None:
                out.append(self._raw[i].decode())
        return "".join(out)


_read: dict[str | None, Vocabulary] = {}
_encoders: dict[int, Encoder] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    if path not in _read:
        _read[path] = Vocabulary(path)
    return _read[path]


def _encoder(key: int, known: Vocabulary) -> Encoder:
    """A worker's encoder, which keeps what it found out from one task to the next."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(known)
    return _encoders[key]


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, model: str | None = None, keep: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again, and give both as digests (with ``keep`` also as such).

    Needs doc_id and text; other columns are ignored, whatever their names.  One row
    for each input row, repeated or not; null and empty texts have no ids and decode to
    the empty text; a null doc_id stays null; an empty table gives no rows.  Marks of the
    vocabulary inside a text are ordinary text.  Texts are taken in chunks up to a space, so that
    memory follows the longest run of characters without one.
    """
    # its size follows from the vocabulary alone, so it goes to every worker
    shared = ready(docs.sparkSession).sparkContext.broadcast(vocabulary(model))
    number = uuid.uuid4().int
    shape = ENCODED + (", ids array<int>, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(number, shared.value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep
        names = [part.split()[0] for part in shape.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                count, ids, texts = 0, [], []
                ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()

                def chunks(value=text.as_py() or "", seen=ids_hash, kept=ids):
                    nonlocal count
                    for chunk in encoder.encode(value):
                        seen.update((("," if count else "") + chunk).encode())
                        count += chunk.count(",") + 1
                        if keep:
                            kept.extend(map(int, chunk.split(",")))
                        yield chunk

                for decoded in encoder.decode(chunks()):
                    text_hash.update(decoded.encode())
                    if keep:
                        texts.append(decoded)
                row = [doc_id, count, ids_hash.hexdigest(), text_hash.hexdigest()]
                for column, value in zip(out, row + [ids, "".join(texts)] * keep):
                    column.append(value)
            arrays = [pa.array(column, kind) for column, kind in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, shape)
