import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from runloom.llm.common import ship

DOC = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("source", StringType()),
    ]
)
#: Names that operators use inside; as columns of an input they must do no harm.
CLASHES = ("size", "rank", "cell", "arc", "row", "token", "class", "comp", "block", "score", "n", "a", "b", "hash", "_text", "_id", "a.b")


@pytest.fixture(scope="session")
def llm(spark):
    return ship(spark)


@pytest.fixture
def documents(llm):
    """A frame of (doc_id, text, source) rows, with clashing extra columns if asked."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        df = llm.createDataFrame(full, DOC)
        if clash:
            for name in CLASHES:
                df = df.withColumn(name, df["text"])
        return df

    return make
