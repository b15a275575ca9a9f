import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, start=0):
        return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    return make
