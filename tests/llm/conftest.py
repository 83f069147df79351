import pytest

LONG = "Lorem ipsum dolor, sit amet. " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    texts = [None, "", " \n\t ", "a", "Ä▁ß 🦊\x00", LONG, LONG, "one two three four five six seven eight nine ten " * 4, "x" * 50_000, "a b\na b\n\na b"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"src{i}", i, "z", 1, b"k") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "one two three four five six", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp int, _row binary")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
