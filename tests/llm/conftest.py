import pytest

SF = "/root/testdata/sf0.001"

#: Null, empty, blank, very long and repeated texts; ties; clashing extra columns.
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\x0b \n ", None, None, 2), (4, "one", "de", "a", None),
    (5, "one two", "de", "b", 7), (6, "Alpha beta gamma delta epsilon zeta", "en", "b", 3),
    (7, "ALPHA beta gamma delta epsilon zeta", "en", "b", 3), (8, "long " * 40000 + "\nThe same shared line here", "en", "c", 200000),
    (9, "The same shared line here\n short\nThe same shared line here ", "en", "c", 10),
    (10, "  the SAME shared line here\nunique content line ten", "fr", "c", 10), (10, "  the SAME shared line here\nunique content line ten", "fr", "c", 10),
    (None, "The same shared line here\nwithout an id", "fr", None, 10), (11, "x" * 30000, "en", "c", 1),
    (12, "é" * 12 + "\n" + "É" * 12 + "\n" + "é" * 9, "fr", "c", 1), (13, "é" * 12, "fr", "c", 1), (14, "<|endoftext|> a<|endoftext|>b  c d", "en", "c", 1),
    (15, "123 456 !!!", "en", "c", 1),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with columns that bear the names of outputs and helpers."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, TEXT string, fp long, row_key long, keep binary, "
              "component_id long, n_lines long, severity string, predicted string, token_ids binary, node long, _prob double, parts string")
    rows = [(*r, "other text " * 3, 1, 2, b"k", 3, 4, "s", "p", b"t", 5, 0.5, "q") for r in EDGE]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
