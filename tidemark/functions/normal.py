"""The normal distribution as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximations of the error function by Cody (1969), numerators and
# denominators from the constant term up. Near zero of erf(x) / x in x^2; up to 4 of
# erfc(x) exp(x^2) in x; beyond it of what is left of that, in 1 / x^2.
NEAR, FAR = 0.46875, 4.0
NEAR_TOP = (3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2,
            3.16112374387056560, 1.85777706184603153e-1)
NEAR_BOTTOM = (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2,
               2.36012909523441209e1, 1.0)
MIDDLE_TOP = (1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3,
              8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1,
              8.88314979438837594, 5.64188496988670089e-1, 2.15311535474403846e-8)
MIDDLE_BOTTOM = (1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3,
                 3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862009858e2,
                 1.17693950891312499e2, 1.57449261107098347e1, 1.0)
FAR_TOP = (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1,
           3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2)
FAR_BOTTOM = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
              1.87295284992346725, 2.56852019228982242, 1.0)


def _polynomial(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """The complementary error function of a column that is not negative, to 14 digits also far out.
    ``x`` is named many times: pass a plain column."""
    square = x * x
    inverse = 1 / square
    fall = F.exp(-square)
    near = 1 - x * _polynomial(NEAR_TOP, square) / _polynomial(NEAR_BOTTOM, square)
    middle = fall * _polynomial(MIDDLE_TOP, x) / _polynomial(MIDDLE_BOTTOM, x)
    rest = inverse * _polynomial(FAR_TOP, inverse) / _polynomial(FAR_BOTTOM, inverse)
    far = fall / x * (1 / math.sqrt(math.pi) - rest)
    return F.when(x <= NEAR, near).when(x <= FAR, middle).otherwise(far)


def normal_cdf(z: str) -> Column:
    """The share of the normal distribution below the column ``z``."""
    upper = erfc(F.abs(z) / math.sqrt(2.0)) / 2
    return F.when(F.col(z) > 0, 1 - upper).otherwise(upper)
