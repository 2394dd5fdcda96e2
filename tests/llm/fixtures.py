"""Odd rows that every operator has to take: nulls, empty and long texts, repeats, clashing column names."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LINE = "the quick brown fox jumps over the lazy dog and runs away from it"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
ROWS = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, " \t\n\x0b\x0c\r ", None, "b", 6),
    (4, LINE, "en", "b", 64),
    (4, LINE, "en", "b", 64),
    (5, LINE.upper(), "en", None, 64),
    (6, "\n".join([LINE] * 12), "en", None, 0),
    (7, "Éé ñandú ß \U0001f600 x y " + LINE, "fr", "c", 1),
    (8, LONG, "en", "c", 1),
    (None, LINE + " again", "en", "c", 1),
    (None, None, None, None, None),
    (9, "#*$%&|<> one", "en", "", 3),
    (10, "a" * 5000, "en", "d", 5000),
]


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, *names):
    """The odd rows with extra columns of these names."""
    from pyspark.sql import functions as F

    df = odd(spark)
    for name in names:
        df = df.withColumn(name, F.lit("extra"))
    return df
