import pytest

ROWS = [
    (1, "The first text, with a line.\nAnd another line here, of ten or more words in all."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "word"),
    (6, "copy of a text that is there twice, word by word, as it was before"),
    (7, "copy of a text that is there twice, word by word, as it was before"),
    (7, "copy of a text that is there twice, word by word, as it was before"),
    (8, "é 日本 naïve <|endoftext|> it's  two   blanks\n\nlines \x1c end"),
    (None, "a row without an id, but with words in it, more than ten of them"),
    (9, "long " * 30_000),
    (10, "x" * 100_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    rows = [(i, t, "en", None if i == 3 else "s0", len(t or ""), i, "clash", 1.5) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part long, ids string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def few(spark):
    """The smallest of the driver's document tables, with its labels."""
    d = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
