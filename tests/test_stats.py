import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablejury.functions import stats as S


def exact_tail(k, n):
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2 ** n


@pytest.mark.parametrize("k,n", [(0, 10), (1, 1), (6, 10), (10, 10), (55, 100), (480, 1000), (520, 1000), (700, 1000)])
def test_binomial_tail(k, n):
    assert S.binomial_tail(k, n) == pytest.approx(exact_tail(k, n), rel=1e-9)


def test_binomial_tail_of_huge_counts_matches_the_normal_limit():
    n = 10 ** 12
    k = n // 2 + 10 ** 6  # two standard deviations
    z = (k - 0.5 - n / 2) / (math.sqrt(n) / 2)
    assert S.binomial_tail(k, n) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-5)


def test_student_tail_known_values():
    assert S.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_shapiro_wilk_published_example():
    """Weights of eleven men, a much printed example: W = 0.79, p = 0.0067."""
    w, p = S.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=5e-4) and p == pytest.approx(0.0067, abs=3e-4)


def test_shapiro_wilk_separates_normal_from_skewed():
    rng = np.random.default_rng(0)
    assert S.shapiro_wilk(rng.normal(size=400))[1] > 0.01
    assert S.shapiro_wilk(rng.exponential(size=400))[1] < 1e-6


def test_constant_column_gives_null_correlation_and_zero_shape(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("c"))
    row = df.agg(S.pearson("x", "c").alias("r"), S.skewness_adjusted("c").alias("s"),
                 S.kurtosis_adjusted("c").alias("k")).first()
    assert row["r"] is None and row["s"] == 0.0 and row["k"] == 0.0


def test_shape_of_short_columns_is_undefined(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    row = df.agg(S.skewness_adjusted("x").alias("s"), S.kurtosis_adjusted("x").alias("k")).first()
    assert row["s"] is None and row["k"] is None


def test_correlation_p_guards(spark):
    df = spark.createDataFrame([(0.5, 12.0), (1.0, 5.0), (0.3, 2.0), (None, 9.0)], "r double, n double")
    p = [r[0] for r in df.select(S.correlation_p_udf("r", "n")).collect()]
    assert p[0] == pytest.approx(0.0979, abs=1e-3) and p[1] == 0.0 and p[2] is None and p[3] is None
