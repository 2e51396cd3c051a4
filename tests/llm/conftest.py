import pytest

from crmkiln.llm.common import DOCUMENT_COLUMNS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row long"


def documents(spark, texts, **columns):
    """A documents table: (doc_id, text) pairs, and columns that clash with names operators use."""
    rows = [
        (doc_id, text, columns.get("lang"), columns.get("source"), len(text or ""), -1, -2)
        for doc_id, text in texts
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


#: Null ids and texts, empty and wordless texts, repeated ids, repeated rows, one long text.
ODD = [
    (None, None), (None, "a b"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "y"), (5, "same row"),
    (5, "same row"), (6, "é😀 Ünï " * 400), (7, "word " * 3000),
]


@pytest.fixture()
def docs(spark):
    return lambda texts, **columns: documents(spark, texts, **columns)


@pytest.fixture()
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture()
def empty(spark):
    return documents(spark, [])


assert set(DOCUMENT_COLUMNS) < set(name.split()[0] for name in SCHEMA.split(", "))
