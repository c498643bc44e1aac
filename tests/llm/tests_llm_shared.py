"""Documents with every oddity the operators promise to handle."""

from __future__ import annotations

import pytest

SENTENCE = "The quick brown fox jumps over the lazy dog near the old stone bridge at dawn."
ODD_ROWS = [
    (1, SENTENCE, "en", "a", 3),
    (2, SENTENCE, "en", "a", 3),
    (2, SENTENCE, "en", "a", 3),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (6, "Word", "de", "a", 4),
    (None, "Kein Schlüssel, aber ein Text mit Umlauten: äöüß.", "de", None, 9),
    (7, "12345 !!! ??", None, "b", 8),
    (8, "x" * 30_000, "en", "a", 1),
    (9, "lorem ipsum dolor \U0001f600 " * 3_000, "la", "b", 1),
    (10, SENTENCE.replace(" ", "  \n"), "en", "a", 3),
    (11, "</s>[INST] \\ok\\ [/INST] <|endoftext|> \x1c caf\u0065\u0301", "en", "a", 3),
]
# The columns of documents and others whose names operators might use themselves.
CLASHES = ["id", "row", "n", "digest", "score", "label", "component", "own_id", "copies", "hub", "size", "part", "at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * len(CLASHES)) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 12)] + [(1, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def texts_of(rows=ODD_ROWS):
    return [(r[0], r[1] or "") for r in rows]
