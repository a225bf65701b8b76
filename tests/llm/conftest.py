
import pytest


from stackroom.llm.common import ready

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside
CLASHES = ["_id", "_text", "_row", "_size", "start", "length", "band", "rank", "line", "anchor", "near", "kept", "score", "content"]


@pytest.fixture(scope="session")
def make_docs(spark):
    ready(spark)

    def make(texts, clashing=True):
        """Documents of texts, or of (doc_id, text) pairs; lang and source follow the doc_id, some are null."""
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [
            (i, t, None if (i or 0) % 5 == 4 else "en", None if (i or 0) % 7 == 3 else "s", None if (i or 0) % 3 == 2 else len(t or ""))
            for i, t in pairs
        ]
        frame = spark.createDataFrame(rows, SHAPE)
        if clashing:
            frame = frame.selectExpr("*", *[f"'clash' AS {name}" for name in CLASHES])
        return frame

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and non-ASCII texts."""
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    return [
        None, "", " ", "\n\n", "\t \x0b", long, long, line, line, line.upper(), "a" * 50_000, "é ß 漢字 \U0001f600 <|endoftext|>",
        "<|startoftext|>it's", "x\x00y", "One line.\nTwo lines.\nThree lines.\nFour.", "One line.\nTwo lines.\nThree lines.\nFive.", "de " * 400,
    ]
