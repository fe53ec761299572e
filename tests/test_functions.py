import math

import pytest
from pyspark.sql import functions as F

from luxflow import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_polarity_rules(spark):
    for rule, want in (("positive", [False, False, True]), ("truthy", [True, False, True]), ("strict", [False, False, True])):
        assert [one(spark, fn.polarity(F.lit(v), rule)) for v in (-1, 0, 1)] == want
    with pytest.raises(Exception, match="polarity must be"):
        one(spark, fn.polarity(F.lit(2), "strict"))
    with pytest.raises(ValueError):
        fn.polarity(F.lit(1), "odd")


def test_scalars(spark):
    assert one(spark, fn.seconds(F.lit(1_500_000), "us", 500_000)) == 2.0
    assert one(spark, fn.finite(F.lit(math.inf))) == 0.0 and one(spark, fn.finite(F.lit(math.inf), nan_only=True)) == math.inf
    assert one(spark, fn.normalize_index(F.lit(-1), F.lit(5))) == 4
    with pytest.raises(Exception, match="index out of range"):
        one(spark, fn.normalize_index(F.lit(5), F.lit(5)))
    assert [one(spark, fn.clip(F.lit(v), 0, 3)) for v in (-2, 2, 9)] == [0, 2, 3]
    assert one(spark, fn.depth_level(F.lit(math.nan), 0.0, 10.0, 10.0)) == 1.0
    assert one(spark, fn.to_byte(F.lit(2.0), F.lit(0.0), F.lit(1.0))) == 255
    assert [one(spark, c) for c in fn.hsv_to_rgb(F.lit(60), F.lit(255), F.lit(255))] == [0, 255, 0]
