import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size int, bucket string, key string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, ties, copies and clashing column names."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards sing loudly in the cold rain near old mills " * 3
    texts = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + "end", "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \t\n\x0b\x0c\r ", None, None),
        (7, "one two", "fr", "c"), (8, "ONE two", "fr", "c"), (9, "é É naïve Straße 日本語 İstanbul ½ ² <|endoftext|> don't", "de", "c"), (10, "word " * 30000, "en", "a"),
        (11, "MIT License. Apache-License mit  license GENERAL public\nlicense gpl v3", "en", "a"), (12, "123 456 !!!", "en", "d"), (13, base, "en", "a"), (None, "one two", "fr", "c"),
        (14, "x" * 300000, "en", "a"), (7, "one two", "fr", "c"), (15, "a b  c", "es", "e"),
    ]
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "x", "y", "z") for i, t, lang, s in texts], KIND)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
