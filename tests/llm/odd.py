"""Documents with everything that may go wrong."""

LONG = "word " * 30_000 + "end"
COPY = "One document that is there many times, with enough words in it to make some shingles of five words. It goes on for a while."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, label int, score double, _key string, n int, bucket string, key string"


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns carry names that operators might use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, 1, 0.5, "x", 3, "b", "k") for r in rows], SCHEMA)


def odd_rows():
    return [(1, None), (2, ""), (3, LONG), (4, COPY), (5, COPY), (6, COPY), (6, COPY), (7, "  \n\n "), (8, "é日本😀 <|endoftext|> x\t\t\ty"), (9, "short"), (None, "a row without an id but with a text of some words"), (-4, "the\nsame\nlines\nthe")]


def odd(spark):
    return table(spark, odd_rows())


def empty(spark):
    return table(spark, odd_rows()).where("1 = 0")
