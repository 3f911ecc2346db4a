import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs; ``extra`` adds columns whose names clash with outputs."""
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F
            for c in ("fp", "h", "root", "component_id", "node", "score", "predicted", "spans", "start", "kind", "b"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make
