import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, _id string, spans string"


def table(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text, lang, source) with further columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None, "x", "y", "z", None) for i, t, lang, src in rows], schema)


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, blanks, ties, repeated rows, copies, near copies and a long text."""
    words = [f"w{i % 97}x{i % 13}" for i in range(400)]
    long = " ".join(f"q{i % 5003}" for i in range(20_000))
    base = " ".join(words[:120])
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + " end", "en", "a"), (4, None, None, None), (5, "", "en", None),
        (6, " \t\n ", "fr", "b"), (7, "one two", "fr", "b"), (7, "one two", "fr", "b"), (None, "one two", None, "b"), (None, None, None, None),
        (8, long, "en", "c"), (9, "é ü 漢字 🎉 Éa", "de", "c"), (10, "x\x0by\x1fz", "de", "c"), (11, " ".join(["same"] * 60), "en", "a"),
        (12, " ".join(words[60:180]), "en", "b"), (13, "tail " + " ".join(words[40:100]) + " head", "en", "b"), (14, long, "en", "c"),
    ]
    return table(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
