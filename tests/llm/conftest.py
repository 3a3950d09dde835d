import pytest
from pyspark.sql import functions as F


@pytest.fixture
def table(spark):
    """Rows (id, text) as documents, with columns whose names operators use themselves."""

    def make(rows, kind="bigint"):
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint"),
                               "row": F.lit(1), "k1": F.lit(2), "kept": F.lit("x"), "id": F.lit(3), "pos": F.lit(4)})

    return make
