import pytest

#: Texts that every operator must take: null, empty, blank, one word, odd characters, one very long word.
ODD = [None, "", " ", " \n\t ", "a", "a  b\r\n c\x0bd\x0ce", "'s don't ​ 日本語 😀 é ▁", "x" * 20_000, "\x00\x01 b"]


@pytest.fixture
def odd():
    return ODD


@pytest.fixture
def documents(spark):
    """Builds a documents table, with extra columns whose names clash with what operators use inside."""

    def build(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, n_tokens int")

    return build
