import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, fp string, row bigint, key string, item string"
LONG = " ".join(f"wort{i % 977}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, None), (4, ""), (5, " \n\t "), (6, "x"), (7, "Año nuevo, ÉTÉ été — 你好 世界 😀 don't  stop\n\n  now"),
    (8, LONG), (8, LONG), (9, 'db_password = "hunter2hunter2"\ntoken: 0123456789abcdef'), (None, "no id here at all"), (None, None),
    (-5, "the the the the a a a a <|endoftext|> the the the the"), (10, "a\r\nb c\x85d　　e\x1cf")]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    rows = [(i, t, None, None, None if t is None else len(t), 1, "fp", 2, "k", "i") for i, t in ROWS]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
