import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts; ids count from 0 unless given."""

    def make(texts, ids=None, **extra):
        rows = [(i if ids is None else ids[i], t, extra.get("lang", "en"), "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]))

    return make


#: Nulls, emptiness, white space alone, ties and repeats, odd characters, and a long text.
ODD = [None, "", " \n\t ", "one", "same words here again", "same words here again", "É ́ ß Σ ΑΣ İ", "a\x00b\x1c c", "x" * 5000, "word " * 20_000, "<|end|> \\<| </s>[INST]"]


@pytest.fixture(scope="session")
def odd():
    return ODD
