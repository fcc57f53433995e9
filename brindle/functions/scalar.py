"""Scalar functions as Columns, with IEEE results where Spark would raise or give null.

Division by zero gives an infinity (0/0 NaN), the logarithm of zero minus infinity and of a negative number NaN. Every
function is an expression of built-in ones, so all work inside whole-stage code generation.
Complex values are structs (re, im); the helpers take and give them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance from 1 to the next double.
EPSILON = 2.220446049250313e-16


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- arithmetic -----------------------------------------------------------------------------------------------------


def divide(a, b) -> Column:
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.when(b != 0, a / b).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())


def reciprocal(x) -> Column:
    return divide(F.lit(1.0), x)


def negate(x) -> Column:
    return -_col(x)


def identity(x) -> Column:
    return _col(x)


def square(x) -> Column:
    return _col(x) * _col(x)


squared_abs = square


def is_invertible(x) -> Column:
    return _col(x) != 0


def is_negative(x) -> Column:
    return _col(x) < 0


def minimal_increase(x) -> Column:
    """The least value that is surely larger at double precision."""
    x = _col(x)
    return x + F.greatest(F.abs(x) * EPSILON, F.lit(5e-324))


def power(x, e) -> Column:
    return F.pow(_col(x), _col(e))


# --- elementary functions -------------------------------------------------------------------------------------------


def _guarded_log(f: Callable[[Column], Column]) -> Callable[[object], Column]:
    def log(x) -> Column:
        x = _col(x).cast("double")
        return F.when(x > 0, f(x)).when(x == 0, -inf()).when(x.isNull(), F.lit(None).cast("double")).otherwise(nan())

    return log


log, log2, log10 = _guarded_log(F.log), _guarded_log(F.log2), _guarded_log(F.log10)


def exp(x) -> Column:
    return F.exp(_col(x))


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), _col(x))


def exp10(x) -> Column:
    return F.pow(F.lit(10.0), _col(x))


def sqrt(x) -> Column:
    return F.sqrt(_col(x))


def rsqrt(x) -> Column:
    return reciprocal(F.sqrt(_col(x)))


def _plain(f: Callable[[Column], Column]) -> Callable[[object], Column]:
    return lambda x: f(_col(x).cast("double"))


absolute = _plain(F.abs)
acos, acosh, asin, asinh, atan = map(_plain, (F.acos, F.acosh, F.asin, F.asinh, F.atan))
cos, cosh, sin, sinh, tan, tanh = map(_plain, (F.cos, F.cosh, F.sin, F.sinh, F.tan, F.tanh))


def atanh(x) -> Column:
    x = _col(x).cast("double")
    return F.when(x == 1, inf()).when(x == -1, -inf()).otherwise(F.atanh(x))


def _fractional(f: Callable[[Column], Column]) -> Callable[[object], Column]:
    """f where a double can have a fraction; larger values, infinities and NaN are whole already (NaN is above all numbers here)."""

    def g(x) -> Column:
        x = _col(x).cast("double")
        return F.when(F.abs(x) < float(1 << 52), f(x)).otherwise(x)

    return g


ceil = _fractional(lambda x: F.ceil(x).cast("double"))
floor = _fractional(lambda x: F.floor(x).cast("double"))
trunc = _fractional(lambda x: x.cast("long").cast("double"))


@_fractional
def round_half_away(x: Column) -> Column:
    whole = x.cast("long").cast("double")
    return F.when(F.abs(x - whole) >= 0.5, whole + F.signum(x)).otherwise(whole)


def signum(x) -> Column:
    return F.signum(_col(x))


def copysign(x, sign) -> Column:
    """The magnitude of x with the sign of `sign`, which a zero has as well."""
    x, sign = _col(x), _col(sign)
    below = (sign < 0) | ((sign == 0) & sign.cast("string").startswith("-"))
    return F.when(below, -F.abs(x)).otherwise(F.abs(x))


#: Terms of the series of erf below SWITCH, and of the continued fraction of erfc above; enough for a double.
SERIES, FRACTION, SWITCH = 44, 60, 2.0
_ROOT = 1.772453850905516  # of pi


def _erf_series(x: Column) -> Column:
    """2 x exp(-x^2) / sqrt(pi) * (1 + t/3 (1 + t/5 (1 + ...))), t = 2 x^2: positive terms alone."""
    t = 2 * x * x
    total = reduce(lambda acc, k: 1 + t / float(2 * k + 1) * acc, range(SERIES, 0, -1), F.lit(1.0))
    return 2 / _ROOT * x * F.exp(-x * x) * total


def _erfc_fraction(x: Column) -> Column:
    """exp(-x^2) / sqrt(pi) / (x + 1/2 / (x + 2/2 / (x + ...))), for x of SWITCH or more."""
    x = F.greatest(x, F.lit(SWITCH))
    return F.exp(-x * x) / _ROOT / reduce(lambda acc, k: x + (k / 2.0) / acc, range(FRACTION, 0, -1), x)


def erf(x) -> Column:
    x = _col(x).cast("double")
    far = (1 - _erfc_fraction(F.abs(x))) * F.signum(x)
    return F.when(F.abs(x) < SWITCH, _erf_series(x)).otherwise(far)


def erfc(x) -> Column:
    x = _col(x).cast("double")
    return F.when(F.abs(x) < SWITCH, 1 - _erf_series(x)).when(x < 0, 2 - _erfc_fraction(-x)).otherwise(_erfc_fraction(x))


#: All functions of one real argument by name.
UNARY: dict[str, Callable[[object], Column]] = {
    "abs": absolute, "squared_abs": squared_abs, "acos": acos, "acosh": acosh, "asin": asin, "asinh": asinh, "atan": atan, "atanh": atanh,
    "cos": cos, "cosh": cosh, "sin": sin, "sinh": sinh, "tan": tan, "tanh": tanh, "ceil": ceil, "floor": floor, "round": round_half_away,
    "trunc": trunc, "log": log, "log2": log2, "log10": log10, "exp": exp, "exp2": exp2, "exp10": exp10, "sqrt": sqrt, "rsqrt": rsqrt,
    "erf": erf, "erfc": erfc, "signum": signum, "negate": negate, "identity": identity, "square": square, "reciprocal": reciprocal,
    "minimal_increase": minimal_increase,
}


def compose(*functions: Callable[[Column], Column]) -> Callable[[object], Column]:
    """compose(f, g)(x) is f(g(x)); one nested expression, so one projection."""
    return lambda x: reduce(lambda acc, f: f(acc), reversed(functions), _col(x))


def combine(op: Callable[[Column, Column], Column], f: Callable[[Column], Column], g: Callable[[Column], Column]) -> Callable[[object], Column]:
    """combine(op, f, g)(x) is op(f(x), g(x))."""
    return lambda x: op(f(_col(x)), g(_col(x)))


def binary(name: str, a, b) -> Column:
    """add, subtract, multiply, divide, min, max, power, bit_and, bit_or, bit_xor of two Columns."""
    a, b = _col(a), _col(b)
    return {
        "add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: divide(a, b), "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b),
        "power": lambda: F.pow(a, b), "bit_and": lambda: a.bitwiseAND(b), "bit_or": lambda: a.bitwiseOR(b), "bit_xor": lambda: a.bitwiseXOR(b),
    }[name]()


#: Identities of the monoids, so that an empty reduction has a value.
MONOID_IDENTITY = {"add": 0.0, "multiply": 1.0, "max": -1.7976931348623157e308, "min": 1.7976931348623157e308, "bit_and": -1, "bit_or": 0, "bit_xor": 0, "concat": ""}


def zero() -> Column:
    return F.lit(0.0)


def one() -> Column:
    return F.lit(1.0)


# --- complex values -------------------------------------------------------------------------------------------------


def complex_(re, im) -> Column:
    return F.struct(_col(re).cast("double").alias("re"), _col(im).cast("double").alias("im"))


def as_complex(x) -> Column:
    return complex_(x, F.lit(0.0))


def real(z) -> Column:
    return _col(z)["re"]


def imag(z) -> Column:
    return _col(z)["im"]


def conj(z) -> Column:
    return complex_(real(z), -imag(z))


def c_add(a, b) -> Column:
    return complex_(real(a) + real(b), imag(a) + imag(b))


def c_sub(a, b) -> Column:
    return complex_(real(a) - real(b), imag(a) - imag(b))


def c_mul(a, b) -> Column:
    return complex_(real(a) * real(b) - imag(a) * imag(b), real(a) * imag(b) + imag(a) * real(b))


def c_div(a, b) -> Column:
    d = c_abs2(b)
    p = c_mul(a, conj(b))
    return complex_(divide(real(p), d), divide(imag(p), d))


def c_scale(z, s) -> Column:
    return complex_(real(z) * _col(s), imag(z) * _col(s))


def c_abs2(z) -> Column:
    return real(z) * real(z) + imag(z) * imag(z)


def c_abs(z) -> Column:
    return F.hypot(real(z), imag(z))


def c_signum(z) -> Column:
    """The sign of the real part."""
    return F.signum(real(z))


def c_equal(a, b) -> Column:
    return (real(a) == real(b)) & (imag(a) == imag(b))


# --- a kind's operations, for code that serves both -----------------------------------------------------------------


class Field:
    """What products and sums need of a kind of values."""

    def __init__(self, kind: str):
        self.complex = kind == "complex"

    def mul(self, a: Column, b: Column) -> Column:
        return c_mul(a, b) if self.complex else a * b

    def conj(self, a: Column) -> Column:
        return conj(a) if self.complex else a

    def neg(self, a: Column) -> Column:
        return c_scale(a, F.lit(-1.0)) if self.complex else -a

    def abs(self, a: Column) -> Column:
        return c_abs(a) if self.complex else F.abs(a)

    def abs2(self, a: Column) -> Column:
        return c_abs2(a) if self.complex else a * a

    def nonzero(self, a: Column) -> Column:
        return (real(a) != 0) | (imag(a) != 0) if self.complex else a != 0

    def sum(self, a: Column) -> Column:
        return complex_(F.sum(real(a)), F.sum(imag(a))) if self.complex else F.sum(a)

    def lit(self, x: complex | float) -> Column:
        return complex_(F.lit(complex(x).real), F.lit(complex(x).imag)) if self.complex else F.lit(float(x))
