import pytest
from llm_rows import SCHEMA, rows


@pytest.fixture(scope="session")
def data() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def stored(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("llm") / "documents")
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
