"""Awkward inputs shared by the tests: nulls, blanks, long texts, repeated rows, ties and clashing columns."""

LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "a", "one two three", "<|endoftext|> it's we're İSTANBUL 12 34", "漢字 かな é ́", LONG, "same words in every copy of this text here", "same words in every copy of this text here"]
#: Names that the operators use themselves.
EXTRA = ", 7L AS id, 'x' AS label, 3 AS n, 'y' AS bands, 'z' AS component, 5 AS tokens, 'q' AS topic, true AS kept, 1 AS ratio, 'w' AS rep, 2 AS leaf, 'h' AS hash"


def documents(spark, texts=None):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s1", None)[i % 3]) for i, t in enumerate(TEXTS if texts is None else texts)]
    if texts is None:
        rows += [(None, "no id here at all", "en", "s0"), (None, None, None, None), (9, TEXTS[9], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.createOrReplaceTempView("edge_documents")
    return spark.sql(f"SELECT *, 4 AS n_chars{EXTRA} FROM edge_documents")
