import random

from pyspark.sql import Window as W, functions as F

from hopsight.functions.ordered import position_in_group, previous_in_group


def rows(spark):
    rng = random.Random(3)
    data = [("hot", rng.randint(1, 50), rng.randint(0, 9)) for _ in range(2000)]
    data += [("hot", 7, 7)] * 500 + [(None, i, i) for i in range(30)] + [(f"g{i % 40}", i, i) for i in range(400)]
    return spark.createDataFrame(data, "g string, a int, b int")


def test_previous_equals_a_window(spark):
    df = rows(spark)
    w = W.partitionBy("g").orderBy("a", "b")
    expected = df.withColumn("prev", F.lag(F.struct("a", "b")).over(w))
    actual = previous_in_group(df, ["g"], ["a", "b"], F.struct("a", "b"), "prev", rows=100)
    key = lambda r: str(r)
    assert sorted(map(key, actual.collect())) == sorted(map(key, expected.collect()))


def test_position_equals_row_number(spark):
    df = rows(spark)
    expected = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("a", "b")) - 1)
    actual = position_in_group(df, ["g"], ["a", "b"], "n", rows=100)
    assert sorted(map(str, actual.collect())) == sorted(map(str, expected.collect()))
