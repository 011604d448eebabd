import pytest

LONG = "word " * 30_000 + "end."


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with NULLs in every column, empty and very long texts, repeated rows, ties and clashing column names."""
    text = "The quick brown fox jumps over the lazy dog, said a.b@mail.example.org to 10.0.0.1."
    rows = [(1, text), (1, text), (2, text), (3, ""), (4, None), (None, text), (None, None), (5, " \n\t "), (6, LONG), (7, "one"),
            (8, "é😀 one two"), (9, "a  b\n\n c "), (10, "\x00"), (11, text + " More."), (5, "another text under a used id")]
    extra = "part int, ids string, set_id string, pii string, key string, term string, score double, bytes long, row string, base string"
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", "y", "p", "k", "t", 0.5, 3, "r", "b") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + extra)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
