import pytest

from tests.llm import samples


@pytest.fixture(scope="session")
def edge_docs(spark):
    return samples.edge_docs(spark)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
