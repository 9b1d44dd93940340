import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs over a few partitions, with columns whose names clash with results."""
    def make(rows, lang="en", extra=True, parts=3):
        data = [(i, t, lang, "s", None if t is None else len(t)) for i, t in rows]
        d = spark.createDataFrame(data, DOCS).repartition(parts) if data else spark.createDataFrame([], DOCS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("score", "kept", "uid", "start", "n_words", "row_hash"):
                d = d.withColumn(name, F.lit("clash"))
        return d
    return make


@pytest.fixture(scope="session")
def spoken():
    """A repeatable supply of texts of random words."""
    import random

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        pool = ["".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
        return " ".join(r.choice(pool) for _ in range(n))
    return make
