import pytest

from matchspark.llm.queries import ship

#: Rows that every operator on documents must take: null and empty texts, ties, repeated rows, null ids, long texts.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."), (2, "the QUICK brown fox jumps over the lazy dog, again and again."), (3, None), (4, ""), (4, ""), (5, " \n\t "),
    (None, "no id here"), (6, "éàü 日本語 ÄÖ 🎉 é"), (6, "another text of the same id"), (7, "x"), (8, "12 34 !?"), (9, "word " * 4000 + "end"), (10, "a" * 3000), (11, "<|endoftext|> it's I'LL"),
    (12, "one two three four five six seven eight nine ten eleven twelve"), (12, "one two three four five six seven eight nine ten eleven twelve"), (13, "a\x00b\x1fc d"),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names clash with results and helpers."""
    rows = [(i, t, "en" if (i or 0) % 2 else "de", 1, "k", 0.5, "r") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, rk string, score double, rep string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
