import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, start int, ids string, score string, size string, fp string, key string"


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns named as the operators' own."""
    long = "the word of a long text and more " * 20_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, long, "en", "b"), (5, "The quick brown fox jumps over the lazy dog.", "en", "b"),
        (5, "The quick brown fox jumps over the lazy dog.", "en", "b"), (None, "a text without an id", None, "c"), (7, "  \n\t ", "de", "c"), (8, "12345 !!! ---", "de", "c"), (9, "Über die Straße läuft der Fuchs 你好 <|endoftext|> 😀", "de", None),
    ]
    return spark.createDataFrame([(*r, 1, 7, "x", "x", "x", "x", "x") for r in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
