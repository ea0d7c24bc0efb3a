"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, k int, h string, row string, fp double"


def docs(spark, texts, langs=None):
    """Rows (id, text) as a table with extra columns."""
    rows = [(i, t, (langs or {}).get(i), "s", len(t or ""), "x", 1, "y", "z", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


LOREM = "the quick brown fox jumps over the lazy dog while seven small birds sing about rain and sun near old stone walls in late may".split()
LONG = " ".join(LOREM[i % len(LOREM)] + str(i % 97) for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, LONG), (6, LONG), (6, LONG), (None, "no id at all"), (7, "Ünïcödé 漢字 \U0001f642 x")]
