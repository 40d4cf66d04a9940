"""Vectors as arrays of doubles, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BALL = 1 - 1e-3


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector of length one in its direction; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))[0]


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def poincare_distance(u: Column, v: Column) -> Column:
    """Distance in the ball; squared norms stay below 1 - 1e-4, the argument above 1 + 1e-5."""
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    inside = lambda a: F.least(square(a), F.lit(1 - 1e-4))
    x = F.greatest(1 + 2 * square(F.zip_with(u, v, lambda a, b: a - b)) / ((1 - inside(u)) * (1 - inside(v))), F.lit(1 + 1e-5))
    return F.transform(F.array(x), lambda x: F.log(x + F.sqrt(x * x - 1)))[0]


def project_to_ball(v: Column) -> Column:
    return F.transform(F.array(norm(v)), lambda n: F.when(n >= BALL, F.transform(v, lambda x: x / n * BALL)).otherwise(v))[0]


def weighted_mean_vectors(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """By ``keys``, sum(w * x) / sum(w) for each component; the plain mean where the weights sum to 0 or less."""
    parts = rows.select(*keys, weight, F.posexplode(vector).alias("_i", "_x"))
    x, w = F.col("_x").cast("double"), F.col(weight)
    mean = F.when(F.sum(w) > 0, F.try_divide(F.sum(w * x), F.sum(w))).otherwise(F.avg(x))
    return parts.groupBy(*keys, "_i").agg(mean.alias("_m")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vector))


def einstein_midpoints(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """The weighted mean of ball points, taken in the Klein model with Lorentz factors."""
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    klein = F.transform(F.array(square(F.col(vector))), lambda n: F.transform(F.col(vector), lambda x: 2 * x / (1 + n)))[0]
    gamma = F.transform(F.array(square(klein)), lambda n: 1 / F.sqrt(1 - F.least(n, F.lit(1 - 1e-9))))[0]
    mean = weighted_mean_vectors(rows.withColumn("_w", gamma * F.col(weight)).withColumn(vector, klein), keys, vector, "_w")
    return mean.withColumn(vector, F.transform(F.array(square(F.col(vector))), lambda n: F.transform(F.col(vector), lambda x: x / (1 + F.sqrt(1 - F.least(n, F.lit(1 - 1e-9))))))[0])
