import pytest

from churnlens.llm.common import prepare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, n long, node long"

#: Nulls in any column, empty and blank texts, ties, repeated rows, a null id, and extra columns with names the operators use.
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "b", 43, "x", 1, 1),
    (2, "The quick brown  fox jumps over the\tlazy dog", "en", "b", 44, None, None, 2),
    (3, None, None, None, None, "x", 1, 1),
    (4, "", "en", None, 0, "x", 1, 1),
    (5, " \n\t ", None, "a", 4, "x", 1, 1),
    (6, "word", "en", "a", 4, "x", 1, 1),
    (6, "word", "en", "a", 4, "x", 1, 1),
    (None, "no id here", "de", "c", 10, "x", 1, 1),
    (7, "1234 5678 !!! ???", None, "c", 17, "x", 1, 1),
    (8, "Licensed under the MIT License.\n" * 3 + "x" * 5000, "en", "é", 5100, "x", 1, 1),
    (9, "a " * 3000, "fr", "é", 6000, "x", 1, 1),
]


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def edges(llm):
    return llm.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(llm):
    return llm.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")
