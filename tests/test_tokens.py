from pyspark.sql import functions as F

from pixelloom.functions import tokens


def test_whole_words(spark):
    df = spark.createDataFrame([("Dog",), ("dogs",)], "t string")
    assert [r.v for r in df.select(tokens.in_vocabulary(F.col("t"), ["dog</w>"]).alias("v")).collect()] == [True, False]
