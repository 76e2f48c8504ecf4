import pytest

#: A text column with null, empty, wordless, short, repeated and very long texts, an unknown id, and columns that clash with results.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog by the river bank today"), (1, "the quick brown fox jumps over the lazy dog by the river bank today"),
    (2, None), (3, ""), (4, " \t\n\x0b\r "), (None, "nobody knows the number of this text"), (5, "one"), (6, "Été à la plage 日本語 🎉 ÀÉ"),
    (7, "x" * 3000), (8, ("lorem ipsum dolor sit amet " * 2000) + "end"), (9, "the quick brown fox jumps over the lazy dog by the river bank Today"),
]


@pytest.fixture(scope="session")
def odd(spark):
    extra = [(i, t, "en" if i else None, "src", None, 7, "k", "v", 0, "w") for i, t in ROWS]
    return spark.createDataFrame(
        extra, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, text_key string, fp string, n_words int, `a.b` string"
    )


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
