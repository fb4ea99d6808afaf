import pytest

SF = "/root/testdata/sf0.001"
CLASHES = "id t row words lines m fp key rest root shard pid bin own rid owner base spans label score url2 kept".split()
LONG = " ".join(f"w{i % 5003}x{i}" for i in range(60_000))
COPY = " ".join(f"copied{i}" for i in range(80))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows():
    """Rows of documents: nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    return [
        (1, COPY, "en", "a", 1),
        (2, COPY, "en", "a", 1),
        (2, COPY, "en", "a", 1),
        (2, "another text under the same id " + LONG[:900], "en", "b", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", "a", 4),
        (None, COPY, "en", None, 1),
        (None, "no id, no copy: " + " ".join(f"single{i}" for i in range(70)), "de", "c", 1),
        (None, "no id, no copy: " + " ".join(f"single{i}" for i in range(70)), "de", "c", 1),
        (6, LONG, "en", "a", len(LONG)),
        (7, "word", "fr", "a", 4),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows with extra columns that carry names which the operators use themselves."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
        f"{c} string" for c in CLASHES
    )
    assert len(names) == len(set(names))
    return spark.createDataFrame([(*r, *(f"extra {c}" for c in CLASHES)) for r in edge_rows], kinds)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
