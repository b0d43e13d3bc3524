import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def sf(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


#: Columns of `documents`, and some whose names operators use themselves.
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("node", T.StringType()), T.StructField("label", T.StringType()), T.StructField("key", T.StringType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """documents((doc_id, text[, source, lang]), ...) with extra columns of clashing names."""

    def make(*rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None, "x", "y", "z", "l", "k") for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


LONG = " ".join(f"w{i * i % 977}x{i}" for i in range(60_000))

#: Null and empty texts, white space, ties, repeated rows, a null id, other scripts, a very long text.
ODD = (
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two three four"), (6, "one two three four"), (None, "one two three four"),
    (7, "é ñ 日本語 😀 <|endoftext|> end"), (8, LONG), (9, LONG + " more"), (10, "a" * 3000), (11, None, None, None), (12, "x\u0000y  z\r\n\r\n  '"), (None, None),
)
