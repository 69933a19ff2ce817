import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the evening comes"),
    (2, "the  quick brown\tfox jumps over the lazy dog again and again until the evening comes"),
    (3, "The quick brown fox jumps over the lazy dog again and again until the evening comes"),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, "short one"),
    (7, "short one"),
    (8, "short  one"),
    (9, "é ü 中文 <|endoftext|> it's we're 12a3 ΣΣ \x01 x"),
    (10, "word " * 9000),
    (11, "word " * 9000 + "end"),
    (None, "an id is missing here but the text is long enough to be cut into pieces of fifty bytes"),
    (12, "xx an id is missing here but the text is long enough to be cut into pieces of fifty bytes"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators also use."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i in (3, 5) else f"src{(i or 0) % 4}", len(t or ""), "x", 1, "y", 2.0, "z") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, salt int, hash string, score double, body string")


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.where("false")
