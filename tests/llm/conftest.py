import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, chunk string, kept boolean, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with the names of helper columns."""
    words = " ".join(f"w{i * 7919 % 1013}" for i in range(3000))
    base = "The quick brown fox jumps over the lazy dog and runs far away from the big house on the green hill"
    near = base.replace("lazy", "sleepy") + " " + " ".join(f"tail{i}" for i in range(40))
    texts = [None, "", "   \n", base, base.upper(), base, words, words + " end", near, near + " more", "id1ot", "mail a.b@c.de and 10.2.3.4", "x" * 20_000]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 0, 1, "c", True, "r") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
