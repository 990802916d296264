"""Statistics Spark has no built-in for, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody, "Rational Chebyshev approximations
# for the error function", Math. Comp. 23 (1969), highest power first.
_ERF_NUM = [
    1.85777706184603153e-1,
    3.16112374387056560e0,
    1.13864154151050156e2,
    3.77485237685302021e2,
    3.20937758913846947e3,
]
_ERF_DEN = [
    1.0,
    2.36012909523441209e1,
    2.44024637934444173e2,
    1.28261652607737228e3,
    2.84423683343917062e3,
]
_MID_NUM = [
    2.15311535474403846e-8,
    5.64188496988670089e-1,
    8.88314979438837594e0,
    6.61191906371416295e1,
    2.98635138197400131e2,
    8.81952221241769090e2,
    1.71204761263407058e3,
    2.05107837782607147e3,
    1.23033935479799725e3,
]
_MID_DEN = [
    1.0,
    1.57449261107098347e1,
    1.17693950891312499e2,
    5.37181101862009858e2,
    1.62138957456669019e3,
    3.29079923573345963e3,
    4.36261909014324716e3,
    3.43936767414372164e3,
    1.23033935480374942e3,
]
_FAR_NUM = [
    1.63153871373020978e-2,
    3.05326634961232344e-1,
    3.60344899949804439e-1,
    1.25781726111229246e-1,
    1.60837851487422766e-2,
    6.58749161529837803e-4,
]
_FAR_DEN = [
    1.0,
    2.56852019228982242e0,
    1.87295284992346725e0,
    5.27905102951428412e-1,
    6.05183413124413191e-2,
    2.33520497626869185e-3,
]
_ONE_OVER_SQRT_PI = 0.56418958354775628695


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def erfc(x: Column) -> Column:
    """Complementary error function, to about double precision, for x >= 0."""
    x = x.cast("double")
    square = x * x
    near = F.lit(1.0) - x * _polynomial(square, _ERF_NUM) / _polynomial(square, _ERF_DEN)
    mid = F.exp(-square) * _polynomial(x, _MID_NUM) / _polynomial(x, _MID_DEN)
    inverse = F.lit(1.0) / square
    tail = inverse * _polynomial(inverse, _FAR_NUM) / _polynomial(inverse, _FAR_DEN)
    far = F.exp(-square) * (F.lit(_ONE_OVER_SQRT_PI) - tail) / x
    return F.when(x <= 0.46875, near).when(x <= 4.0, mid).when(x.isNotNull(), far)


def two_proportion_z(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """z of rate_a - rate_b with the pooled standard error; NULL for an empty group.

    Its two-sided p-value is erfc(|z| / sqrt(2)).
    """
    a, b = n_a.cast("double"), n_b.cast("double")
    pooled = F.try_divide(hits_a + hits_b, n_a + n_b)
    spread = F.sqrt(
        pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b))
    )
    return F.try_divide(F.try_divide(hits_a, a) - F.try_divide(hits_b, b), spread)
