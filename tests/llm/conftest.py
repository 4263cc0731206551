import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "a"),
    (3, "THE QUICK  brown fox\tjumps over the lazy dog and runs away from the big bad Wolf", "b"),
    (4, None, "b"),
    (5, "", None),
    (6, " \n\t ", None),
    (7, "one", "c"),
    (8, "one two", "c"),
    (9, "😀 é e\u0301 ﬁ Straße\u00a0x " * 3, "c"),
    (10, "long " * 30_000, "d"),
    (11, "mail a.b+c@mail.example.com, host 10.0.0.255 or 1.2.3.256, card 4111 1111 1111 1111 call +1 (555) 010-9999.", "d"),
    (None, "no key", "d"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rows = [(i, t, s, None, "x", 0, 0.5, "y") for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, spans string, size int, score double, n string").coalesce(2).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(2)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
