import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; a further column of the input may have any of them.
CLASHING = ("row", "key", "chunk", "n", "token", "blob", "digest", "page", "_part", "language", "kept", "score", "c")


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text, lang, source) frames with further columns of clashing names."""

    def make(rows):
        rows = [(*row, *(None,) * (4 - len(row))) for row in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return df.withColumns({name: F.lit(name) for name in CLASHING})

    return make
