"""Small frames for the edge cases that every operator must define."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards watch from a wooden tower near the river "
         "and nobody in the old village knows what the strange green light above the hills could possibly mean")


def docs(spark, rows):
    """(doc_id, text[, lang]) rows as the documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_docs(spark):
    """Nulls, empties, blanks, a very long text, ties and repeated rows."""
    return docs(spark, [(1, PROSE), (2, PROSE), (2, PROSE), (None, PROSE), (3, None), (4, ""), (5, " \n\t "),
                        (6, "a"), (7, "word " * 60_000), (8, "x" * 50_000), (9, PROSE, None), (None, None, None),
                        (10, "☃ 漢字 ﬁ ́ 1234 <|endoftext|> tail")])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
