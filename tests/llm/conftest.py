import pytest
from llm_rows import edge_texts
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use on their way.
        T.StructField("score", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("blob", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, "d", "b") for i, t in edge_texts()]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
