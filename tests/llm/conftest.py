import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text[, lang[, source]]) tuples."""
    def build(*rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            d, t, lang, source = (*r, *(None,) * (4 - len(r)))
            full.append((d, t, lang, source, None if t is None else len(t)))
        return spark.createDataFrame(full, DOCUMENTS)
    return build


# texts every operator must take: null, empty, blank, one word, tabs, long, repeats, ties
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Ünïcödé 漢字 \U0001F600 naïve"), (6, "a" * 30_000),
       (7, "the same line\n" * 40), (8, "same text here"), (8, "same text here"), (9, "same text here"),
       (None, "no id at all"), (10, "x\x00y \x1c z <|endoftext|> it's  'll 　 end  ")]
