"""Small tables for the training-data operators."""

import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of ``(doc_id, text)`` or longer rows, with a clashing column."""

    def build(rows):
        full = [(*r, *(None,) * (5 - len(r)), "clash") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd():
    """Rows that every operator must take: nulls, blanks, repeats, a very long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two three"), (None, "no id here"),
        (6, long), (7, long), (8, "Ünï çødé \U0001f600 text, with symbols #1 & more\nand lines\nand lines"),
    ]
