import pytest

#: Texts that every operator must take: null, empty, blank, odd white space, marks, repeats, long.
ODD = [None, "", "   ", "one", "a b c d e f g", "a b c d e f g", "Ünïcode   mixed line", "<|im_end|> <|endoftext|>", "\x00\x1f odd\tbytes\r\n", "日本語のテキスト", "word " * 30_000, "!?!"]


@pytest.fixture
def odd(spark):
    """doc_id, text and columns whose names operators use inside; one row twice, one null id."""
    rows = [(i, t, "x", 1, "k", 0.5) for i, t in enumerate(ODD)] + [(3, "one", "x", 1, "k", 0.5), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, kept string, score double")


@pytest.fixture
def none(odd):
    return odd.where("false")
