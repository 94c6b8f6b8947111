import pytest

#: Texts that every operator must take: null, empty, blank, short, odd, repeated and very long ones.
TEXTS = [None, "", " \n\t ", "a", "word " * 30000, "x" * 200000, "Le même été, où l'on était.", "日本語 🙂 text", "<|endoftext|> it's ▁", "same line here of many words to be copied\nsame line here of many words to be copied", "same line here of many words to be copied", "\x00\x01 control", "the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy dog again"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with clashing extra columns."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), i, "x", "y", "z", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[-1], rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken int, ld_lang string, score string, id string, size int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
