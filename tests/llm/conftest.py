import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_text` string, kept string, start string, `__key` string"
LONG = "long words here and there " * 20_000
#: One unbroken run, and a long text with very many matches of every kind.
RUN, MATCHES = "aB3" * 330_000, "trash can pathetic token=abcdefgh12 me@some.org 1234567890 " * 8_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing column names."""
    texts = [None, "", "A b c", "a B c", "a b c", " \t\n ", LONG, LONG, "one two three four five six seven", "One two three four five six seven", "x" * 3000, "é　ü  ß", "password = abcdefgh1234", "a <|endoftext|> b<|endoftext|>"]
    rows = [(i, t, "en", f"s{i % 2}", 1, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [(8, texts[8], "en", "s0", 1, None, None, None, None), (8, texts[8], "en", "s0", 1, None, None, None, None), (None, "a b c", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def long_texts():
    return [RUN, MATCHES, "a@" * 500_000]
