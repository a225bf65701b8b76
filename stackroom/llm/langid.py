"""Language by compression: the dictionary that makes a text smallest names its language.

Each language has a raw-content Zstandard dictionary: lines of a bounded sample of pieces of its
learning texts, without lines that the sample holds in two languages.  A whole text, its
letters lowered, is compressed in blocks with each dictionary.  What wins by a narrow margin
is not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from stackroom.llm.common import ready, shape_of, together

DICTIONARY_BYTES = 128 << 10  # of one language at most
ALL_BYTES = 4 << 20  # of all dictionaries together, about
LEAST_BYTES = 256  # of one language, however many there are
SAMPLED = 2  # times a dictionary's bytes are drawn from its learning texts
PIECE = 4 << 10  # characters that are drawn or not as one
BLOCK = 16 << 10
LEVELS = (9, 12)
MARGIN = 0.01  # of the smallest size, by which it must win; one byte at least
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def dictionary_bytes(languages: int) -> int:
    """The share of each language, so that all together stay in bounds."""
    return max(LEAST_BYTES, min(DICTIONARY_BYTES, ALL_BYTES // max(1, languages)))


def learn(labelled: DataFrame, own_bytes: int | None = None) -> dict[str, bytes]:
    """A dictionary for each value of ``lang``, from rows (doc_id, text, lang).

    Texts of any length teach: pieces of ``PIECE`` characters are drawn by a hash, each language's in proportion
    to all it has.  No language is left out; the more there are, the shorter are their
    dictionaries.  The driver gets one number and about ``SAMPLED`` dictionaries' bytes for each.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    totals = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total"))
    totals = totals.select("lang", "total").toPandas()
    own_bytes = own_bytes or dictionary_bytes(len(totals))
    spark = labelled.sparkSession
    # a number for each language, whose whole dictionary every worker gets later on
    shares = spark.createDataFrame(
        [(lang, SAMPLED * own_bytes / total) for lang, total in zip(totals["lang"], totals["total"])], "lang string, share double"
    )
    shape = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PIECE).cast("int"))
    place = F.xxhash64("doc_id", "text")
    drawn = lambda i: (F.xxhash64(place, i).bitwiseAND((1 << 52) - 1)) / float(1 << 52) < F.col("share")
    chosen = usable.join(F.broadcast(shares), "lang").withColumn("pieces", F.filter(shape, drawn)).where(F.size("pieces") > 0)
    pieces = chosen.select("lang", place.alias("place"), F.transform("pieces", lambda i: F.substr("text", i * PIECE + 1, F.lit(PIECE))).alias("pieces"))
    lines: dict[str, dict[str, None]] = {lang: {} for lang in sorted(totals["lang"])}
    for row in pieces.orderBy("lang", "place").collect():
        for piece in row.pieces:
            lines[row.lang].update(dict.fromkeys(piece.lower().split("\n")))
    # what a draw has left without a piece is taught by one of its texts, the first by hash
    missing = [lang for lang, found in lines.items() if not found]
    if missing:
        names = spark.createDataFrame([(lang,) for lang in missing], "lang string")
        first = usable.join(F.broadcast(names), "lang").groupBy("lang").agg(F.min_by(F.substr("text", F.lit(1), F.lit(PIECE)), place).alias("piece"))
        for row in first.collect():
            lines[row.lang].update(dict.fromkeys(row.piece.lower().split("\n")))
    owners: dict[str, int] = {}
    for found in lines.values():
        for line in found:
            owners[line] = owners.get(line, 0) + 1
    out = {}
    for lang, found in lines.items():
        own = [line for line in found if owners[line] == 1] or list(found)
        out[lang] = "\n".join(own).encode()[-own_bytes:].rjust(8)  # Zstandard takes no shorter dictionary
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self._first, self._second = (
            [self._compressor(dictionaries[lang], level) for lang in self.languages] for level in LEVELS
        )

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        return zstandard.ZstdCompressor(
            level=level, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    @staticmethod
    def _sizes(compressors: list, blocks: list[bytes]) -> np.ndarray:
        return np.array([sum(len(c.compress(block)) for block in blocks) for c in compressors])

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (1 for a clear case, shared out among equals), margin as a share of the smallest size."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        raw = text.lower().encode()
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        sizes = self._sizes(self._first, blocks)
        if (sizes == sizes.min()).sum() > 1:
            sizes = sizes + self._sizes(self._second, blocks)
        best = int(sizes.argmin())
        over = sizes - sizes[best]
        score = 1.0 / float(np.exp2(-np.minimum(over, 60)).sum())
        margin = int(np.partition(over, 1)[1]) / int(sizes[best]) if len(over) > 1 else 1.0
        return self.languages[best], score, margin


PREDICTED = "lang_pred string, score double, accepted boolean"


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row, lang_pred, score and accepted; of a kept ``text`` there is one copy.

    Only text is looked at.  Null texts and texts without a letter are ``und`` with score 0, as is
    everything where nothing was learned; they and texts whose two smallest encodings differ by
    less than ``MARGIN`` of the smallest are not accepted; where only one language is known, texts with letters are.  Languages that tie are
    compressed at the other level too; of those that still tie the first by name is told.  One row for each input row; an empty table gives none.
    """
    # a bounded number of dictionaries of bounded size
    shared = ready(docs.sparkSession).sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            told = [classify(text.as_py()) for text in batch.column("_text")]
            columns = [
                batch.column("given"),
                batch.column("_text"),
                pa.array([t[0] for t in told], pa.string()),
                pa.array([t[1] for t in told], pa.float64()),
                pa.array([t[0] != UNKNOWN and t[2] >= MARGIN and t[2] > 0 for t in told], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["given", "_text", "lang_pred", "score", "accepted"])

    given, back = together(tuple(name for name in keep if name != "text"), PREDICTED)
    back += [F.col("_text").alias("text")] * ("text" in keep)
    rows = docs.select(given, F.col("text").cast("string").alias("_text"))
    told = rows.mapInArrow(run, shape_of(rows, f"_text string, {PREDICTED}"))
    return told.select(*back, *[part.split()[0] for part in PREDICTED.split(", ")])


def held_out(parts: int = 4, part: int = 2):
    """Whether a row is kept from learning, by its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict all rows; adds held_out.

    The prediction never sees lang, source or doc_id.  Rows without lang or text teach nothing.
    """
    learning = docs.where(~held_out()).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    given, back = together(tuple(name for name in keep if name != "text"), PREDICTED + ", held_out boolean")
    rows = docs.select(given, held_out().alias("held_out"), "text")
    text = ("text",) * ("text" in keep)
    told = predict(rows, learn(learning), ("given", "held_out", *text))
    return told.select(*back, *text, "held_out", "lang_pred", "score", "accepted")
