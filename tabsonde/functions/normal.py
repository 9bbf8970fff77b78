"""Normal distribution as Column expressions (Spark has no erf).

norm_cdf follows Hart (1968) in the form given by West (2005), norm_ppf is Wichura's
algorithm AS 241 (1988). Both stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients.
HART_NUMERATOR = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
                  112.079291497871, 221.213596169931, 220.206867912376]
HART_DENOMINATOR = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
                    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
AS241_CENTRE = (
    [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
     4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
     1.3314166789178437745e2, 3.3871328727963666080e0],
    [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
     2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
     4.2313330701600911252e1, 1.0])
AS241_MIDDLE = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
     4.63033784615654529590e0, 1.42343711074968357734e0],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
     2.05319162663775882187e0, 1.0])
AS241_TAIL = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
     5.46378491116411436990e0, 6.65790464350110377720e0],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0])


def _horner(coefficients, x):
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    near = e * _horner(HART_NUMERATOR, a) / _horner(HART_DENOMINATOR, a)
    fraction = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = e / fraction / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(a < 7.07106781186547, near).when(a <= 37, far).otherwise(F.lit(0.0))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def norm_log_cdf(z: Column) -> Column:
    """ln Phi(z), finite for any z."""
    q = 1 / (z * z)
    series = F.log1p(-q * (1 - 3 * q * (1 - 5 * q * (1 - 7 * q))))
    far = -z * z / 2 - F.log(-z) - F.lit(0.5 * math.log(2 * math.pi)) + series
    return F.when(z < -12, far).when(z > 5, F.log1p(-norm_cdf(-z))).otherwise(F.log(norm_cdf(z)))


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal; null outside (0, 1)."""
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    centre = q * _horner(AS241_CENTRE[0], r0) / _horner(AS241_CENTRE[1], r0)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    r1, r2 = r - 1.6, r - 5.0
    middle = _horner(AS241_MIDDLE[0], r1) / _horner(AS241_MIDDLE[1], r1)
    tail = _horner(AS241_TAIL[0], r2) / _horner(AS241_TAIL[1], r2)
    outer = F.signum(q) * F.when(r <= 5, middle).otherwise(tail)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (F.abs(q) <= 0.425), centre).when(inside, outer)
