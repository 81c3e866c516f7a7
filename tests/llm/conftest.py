import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today.\nA line.\nThe quick brown fox jumps over the lazy dog."),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, "a  b\n\nc's 12 é世 <|endoftext|> x\r\n"),
    (6, "word " * 5000),
    (7, "The quick brown fox jumps over the lazy dog again and again today.\nA line.\nThe quick brown fox jumps over the lazy dog."),
    (8, "Ünïcode text ÀÉ with\u00a0spaces and 日本語 words"),
    (None, "a row without an id"),
    (9, "one two"),
    (9, "one two"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{k}", len(t or ""), 0.5, "x", 7) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, n_words int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
