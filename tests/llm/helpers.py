"""Small fixtures shared by the tests of the text operators."""

EDGE_TEXTS = [
    None, "", "   \n\t ", "one", "a\nb\n", "é漢字 'tis we'll  x　y", "word " * 3000, "Z" * 30_000,
    "The quick brown fox jumps over the lazy dog. " * 4, "The quick brown fox jumps over the lazy dog. " * 4,
]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "key string, label string, words string, n double, start int")


def edge_docs(spark, more=()):
    """Documents with nulls, repeated rows, long texts, and columns whose names operators use inside."""
    texts = [*EDGE_TEXTS, *more]
    rows = [(i, t, None, "s", None if t is None else len(t), "k", "l", "w", 1.0, 1) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "a row without id, said here", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
