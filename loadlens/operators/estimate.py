"""Monte Carlo estimate of pi with points that can be computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Two primes below 2^31 and, for each, a step near an irrational part of
# it (the powers of the inverse plastic number).  A product of two values below 2^31
# fits a long, so a point is exact for every number, and points repeat only after
# the product of the primes.
PRIME_X, PRIME_Y = 2_147_483_647, 2_147_483_629
STEP_X, STEP_Y = 1_621_087_444, 1_223_722_696


def _coordinate(number: Column, prime: int, step: int) -> Column:
    place = F.pmod(F.pmod(number, F.lit(prime)) * F.lit(step).cast("bigint"), F.lit(prime))
    return place / F.lit(prime) * 2 - 1


def estimate_pi(numbers: DataFrame, number: str) -> DataFrame:
    """Share, times four, of points in the unit circle; one point per number."""
    i = F.col(number).cast("bigint")
    x, y = _coordinate(i, PRIME_X, STEP_X), _coordinate(i, PRIME_Y, STEP_Y)
    return numbers.agg(
        F.count(F.lit(1)).alias("points"), F.count_if(x * x + y * y <= 1).alias("inside")
    ).withColumn("pi", F.col("inside") * 4 / F.col("points"))


def monte_carlo_pi(spark: SparkSession, points: int, slices: int = 10) -> DataFrame:
    """The estimate over ``points`` numbers made in ``slices`` tasks."""
    return estimate_pi(spark.range(1, points + 1, 1, slices), "id")
