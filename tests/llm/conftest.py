import pytest

#: doc_id, text: null and empty texts, one word, ties, repeated rows, a reused id, white space of all kinds, a long text.
ROWS = [
    (1, None), (2, ""), (3, "word"), (4, "two words"), (5, " \t\n\x0b\x0c\r "), (6, "the cat sat on the mat and looked at the dog in the yard today again"),
    (7, "the cat sat on the mat and looked at the dog in the yard today again"), (7, "the cat sat on the mat and looked at the dog in the yard today again"),
    (8, "Extra start the cat sat on the mat and looked at the dog in the yard today again and an end"), (8, "another text under the same id, Ärger über 日本語 words"),
    (None, "the cat sat on the mat and looked at the dog in the yard today again"), (9, "a b " * 4000), (10, "x" * 3000 + " y"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """With other columns, some named as operators name their own."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, 2, 3) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark int, score int, row int").repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 1), (9, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
