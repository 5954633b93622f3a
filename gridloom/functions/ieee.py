"""IEEE-754 columns: the only place that divides, takes logarithms or compares doubles.

Spark raises on division by zero, gives NULL for the logarithm of nothing, and orders NaN above
all numbers; arrays need infinities, NaN, and comparisons with NaN that are false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b with x/0 = inf of x's sign and 0/0 = NaN. A negative zero divisor counts as zero."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def log(x: Column, of: Column | None = None) -> Column:
    """Natural logarithm: -inf at zero, NaN below."""
    value = F.log(x) if of is None else of
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(value)


def log2(x: Column) -> Column:
    return log(x, F.log2(x))


def log10(x: Column) -> Column:
    return log(x, F.log10(x))


def log1p(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < -1), NAN).when(x == -1, -INF).otherwise(F.log1p(x))


def mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor; mod(x, 0) = x."""
    r = F.try_mod(x, y)
    return F.when(y == 0, x).when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


def rem(x: Column, y: Column) -> Column:
    """Remainder with the sign of the dividend; rem(x, 0) = x."""
    return F.when(y == 0, x).otherwise(F.try_mod(x, y))


def sign(x: Column) -> Column:
    return F.when(F.isnan(x), NAN).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def fix(x: Column) -> Column:
    """Round towards zero, keeping infinities and NaN."""
    return keep_special(x, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def keep_special(x: Column, value: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(value.cast("double"))


def floor(x: Column) -> Column:
    return keep_special(x, F.floor(x))


def ceil(x: Column) -> Column:
    return keep_special(x, F.ceil(x))


def round_half_away(x: Column) -> Column:
    return keep_special(x, F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)))


_COMPARE = {"lt": "__lt__", "gt": "__gt__", "le": "__le__", "ge": "__ge__", "eq": "__eq__"}


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison in which NaN is unequal to, and not above or below, everything."""
    if op == "ne":
        return ~compare("eq", a, b)
    out = getattr(a, _COMPARE[op])(b)
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return ~nan & out


def truth(x: Column) -> Column:
    """Non-zero is true, NaN included."""
    return x.cast("double") != 0


#: Element-wise functions by name, over doubles.
UNARY = {
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "ln": log, "lg": log2, "log10": log10, "log1p": log1p, "expm1": F.expm1,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "sqrt": F.sqrt, "cbrt": F.cbrt, "abs": F.abs, "sign": sign, "floor": floor, "ceil": ceil, "round": round_half_away,
    "fix": fix, "trunc": fix, "pow2": lambda x: x * x, "conj": lambda x: x, "real": lambda x: x, "imag": lambda x: x * 0,
    "angle": lambda x: F.when(F.isnan(x), NAN).when(x < 0, math.pi).otherwise(0.0), "arg": lambda x: F.when(F.isnan(x), NAN).when(x < 0, math.pi).otherwise(0.0),
}

# Mathematical constants.
CONSTANTS = {
    "e": math.e, "log2e": math.log2(math.e), "log10e": math.log10(math.e), "pi": math.pi, "inv_pi": 1 / math.pi, "inv_sqrtpi": 1 / math.sqrt(math.pi),
    "ln2": math.log(2), "ln10": math.log(10), "sqrt2": math.sqrt(2), "sqrt3": math.sqrt(3), "inv_sqrt3": 1 / math.sqrt(3),
    "egamma": 0.5772156649015329, "phi": (1 + math.sqrt(5)) / 2,
}


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many decimal places, halves away from zero: of x·10ᵈ in doubles, as SQL engines do, without a decimal for every value."""
    scale = 10.0**digits
    at = x * scale
    near = F.rint(at)
    off = at - near
    away = F.when((at > 0) & (off == 0.5), 1.0).when((at < 0) & (off == -0.5), -1.0).otherwise(0.0)
    return F.when(F.abs(at) < INF, (near + away) / scale).otherwise(x) + 0.0
