import os

import pytest

SF = "/root/testdata/sf0.001"

#: Nulls, blanks, repeats, ties, one long text, characters of all widths.
EDGE_TEXTS = [
    None, "", " \n\t ", "one", "one", "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t",
    "Ünïcödé wörds no break 漢字 😀 é İ ẞ <|endoftext|> x<|startoftext|>y", "the " * 3000, "x" * 5000, "\x0b\x0c\x85 \x1c a\x00b",
    "It's we've I'm they'll 'twas 12345 3.14 --- !!! ??",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with a repeated row, a null id and extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "src0", "x") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], (None, "a b c d e f g h i j k l m n o p q r s t", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, n_words string").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def sf():
    assert os.path.isdir(SF)
    return SF
