import pytest

#: Rows every text operator must take: nulls, empty and white-space texts, repeats, ties, one very long text.
LONG = " ".join(f"word{i % 977} and{i % 131}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(0, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1), (1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 4), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (None, "one two", "en", "b", 7), (5, LONG, "en", "a", len(LONG)), (6, LONG + " tail", "en", "a", len(LONG) + 5), (7, "é 漢字 \U0001f600  x", "fr", "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns whose names clash with those that operators add
    return docs.selectExpr("*", "1 as k", "'x' as t", "2 as size", "'y' as tokens", "3 as c", "'z' as masked", "4 as score")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
