import pytest

ODD = [None, "", " ", "One word", "word " * 3, "a b c d e f g h", "a b c d e f g h", "Ünïcode é😀 text with Some Words and more words", "x" * 30_000, "lorem ipsum dolor sit amet " * 3000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, short, equal and very long texts; null and repeated ids; columns whose names clash with inner ones."""
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, None if i % 3 else "src", 7, f"x{i}") for i, t in enumerate(ODD)]
    rows += [rows[5], rows[5]]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string"
    df = spark.createDataFrame(rows, names)
    for c in ("k", "cid", "w", "uid", "base", "spans", "predicted", "token", "n", "_part", "curve", "shard", "component_id"):
        df = df.selectExpr("*", f"'clash' as {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
