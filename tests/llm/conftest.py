import pytest

WORDS = "the of and to in a is that it for on was be as with by this are from or an at not have".split()


def prose(rnd, n, words=WORDS):
    return " ".join(rnd.choice(words) + (rnd.choice("abcdefgh") if rnd.random() < 0.3 else "") for _ in range(n))


@pytest.fixture
def docs(spark):
    """Rows -> documents with two more columns that clash with names the operators use."""

    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), 7, "x") for i, t, lang, src in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, id string")

    return make
