import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text[, lang[, source]]) rows, with two more columns of clashing names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), 7, "k") for d, t, lang, s in full], DOCS)

    return make


#: Null and empty texts, white space, very long texts and words, repeated rows, a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e f " * 3000), (6, "x" * 50_000), (7, "ÀÉ 🙂 zß\n\nÀÉ 🙂 zß"), (4, "word"), (None, "lost words of a row without a number"), (8, "12 " * 40)]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
