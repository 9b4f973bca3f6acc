import pytest

#: Extra columns whose names the operators use inside, too.
CLASH = "key string, n long, ids string, kept string, blob_id string, size string, copy string, position string, fp string, token string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, short and long texts, repeated rows and copies, and clashing names."""
    long = " ".join(f"w{i % 997} the of and to" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and the dog ran to the house of a man.", "en", "a"), (2, "The cat sat on the mat and the dog ran to the house of a man.", "en", "a"), (2, "The cat sat on the mat and the dog ran to the house of a man.", "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, " \t\n\x0b\x0c\r ", "xx", "b"), (6, "one two", "en", "b"), (7, "ONE  two", "en", "b"), (None, "one two", "en", "b"), (8, long, "en", "a"), (9, "é ß x " * 80, "de", "b"), (10, "a" * 70_000, None, "a"),
    ]
    frame = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *["clash"] * 1, 7, *["clash"] * 8) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
