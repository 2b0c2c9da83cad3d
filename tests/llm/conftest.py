import pytest

LONG = "".join(f"word{i} " for i in range(300))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "s"), (2, "the quick  brown fox\njumps over the lazy dog again ", "en", "s"), (3, None, "en", None), (4, "", None, "s"), (5, LONG, "en", "s"),
        (6, LONG + "tail of another text here", "en", "s"), (7, "le chat été noir dans la maison", "fr", "t"), (7, "le chat été noir dans la maison", "fr", "t"), (None, "no id here at all but words", "en", "s"),
        (8, "12 34 !!", "en", "s"), (9, LONG[:1200] + "é" * 500 + LONG[1200:], None, "s"), (10, "<|endoftext|> it's <|im_end|> a▁b", "en", "s"),
    ]
    kinds = "doc_id long, text string, lang string, source string, digest string, block int, slot int, n_chars long, row string, node long"
    return spark.createDataFrame([(*r, "x", 1, 2, len(r[1] or ""), "r", 5) for r in rows], kinds).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
