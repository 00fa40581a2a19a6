import pytest


@pytest.fixture(autouse=True, scope="session")
def few_partitions(spark):
    """Small tables: Python workers cost more than the rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
