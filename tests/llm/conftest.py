import pytest

#: Texts of every awkward kind, with nulls, ties and repeated rows.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."), (2, "The quick brown fox jumps over the lazy dog and runs away."), (2, "The quick brown fox jumps over the lazy dog and runs away."),
    (3, ""), (4, None), (5, " \t\n"), (6, "one"), (7, "two words"), (None, "no id at all"), (8, "Ünïcödé 日本語 text 😀 with \x00 bytes"), (9, "A" * 5000), (10, "x y z " * 4000),
]


@pytest.fixture
def documents(spark):
    """doc_id, text, and columns that clash with what operators add."""
    rows = [(i, t, "s", 1, "old", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int, spans string, ids int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
