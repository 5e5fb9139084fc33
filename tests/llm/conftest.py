import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents: (id, text) or (id, text, lang, source), with an extra column of a clashing name."""

    def build(rows, extra="_text"):
        full = [(r[0], r[1], (r[2] if len(r) > 2 else None), (r[3] if len(r) > 3 else None), None, 7) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra} int")

    return build


#: Texts that every operator must stand: null, empty, blank, no letters, odd white space, one word, ties, repeats.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!"), (5, "word"), (5, "word"), (None, "word"), (6, "a b c \x1c d"), (7, "é" * 30), (8, "😀 😀 😀"), (9, "x" * 3000), (None, None)]


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture
def many_ranges(spark):
    """Small tables are dealt to several tasks, as large ones are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)
