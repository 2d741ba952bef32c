"""Math functions with the reference rules for rounding, errors and exact angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division, toward zero."""
    return F.floor(F.abs(a) / F.abs(b)).cast("bigint") * F.signum(a * b).cast("bigint")


def to_int(c: Column) -> Column:
    """Float to integer: half to even (a plain cast truncates)."""
    return F.rint(c).cast("bigint")


def trunc(c: Column, digits: int = 0) -> Column:
    scale = F.lit(10.0**digits)
    return F.when(c >= 0, F.floor(c * scale)).otherwise(F.ceil(c * scale)) / scale


def power(a: Column, b: Column) -> Column:
    """1 to any power, and anything to the power 0, is 1 even for NaN."""
    return F.when((a == 1) | (b == 0), F.lit(1.0)).otherwise(F.pow(a, b))


def ln_strict(c: Column) -> Column:
    """ln that raises for zero and negative arguments."""
    return F.when(c > 0, F.ln(c)).when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.raise_error(F.lit("cannot take logarithm of zero or a negative number")).cast("double")
    )


def _exact(angle: Column, value: Column, table: dict[int, float]) -> Column:
    out = value
    for deg, exact in table.items():
        out = F.when(F.pmod(angle, F.lit(360.0)) == deg, F.lit(exact)).otherwise(out)
    return out


def sind(c: Column) -> Column:
    """Sine of degrees, exact at multiples of 30 where the value is rational."""
    return _exact(c, F.sin(F.radians(c)), {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5})


def cosd(c: Column) -> Column:
    return _exact(c, F.cos(F.radians(c)), {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5})


def tand(c: Column) -> Column:
    return _exact(c, F.tan(F.radians(c)), {0: 0.0, 45: 1.0, 135: -1.0, 180: 0.0, 225: 1.0, 315: -1.0})


def cotd(c: Column) -> Column:
    """Cotangent of degrees, exact where the tangent is 1 or -1, 0 at 90 and 270; infinite at 0 and 180."""
    return _exact(c, 1 / F.tan(F.radians(c)), {45: 1.0, 90: 0.0, 135: -1.0, 225: 1.0, 270: 0.0, 315: -1.0, 0: float("inf"), 180: float("-inf")})


def _at(c: Column, value: Column, table: dict[float, float]) -> Column:
    out = value
    for x, exact in table.items():
        out = F.when(c == x, F.lit(exact)).otherwise(out)
    return out


def asind(c: Column) -> Column:
    """Inverse sine in degrees, exact at the halves; an argument beyond 1 raises."""
    bad = F.abs(c) > 1
    return F.when(bad, F.raise_error(F.lit("input is out of range")).cast("double")).otherwise(
        _at(c, F.degrees(F.asin(c)), {-1.0: -90.0, -0.5: -30.0, 0.0: 0.0, 0.5: 30.0, 1.0: 90.0})
    )


def acosd(c: Column) -> Column:
    bad = F.abs(c) > 1
    return F.when(bad, F.raise_error(F.lit("input is out of range")).cast("double")).otherwise(
        _at(c, F.degrees(F.acos(c)), {-1.0: 180.0, -0.5: 120.0, 0.0: 90.0, 0.5: 60.0, 1.0: 0.0})
    )


def atand(c: Column) -> Column:
    return _at(c, F.degrees(F.atan(c)), {-1.0: -45.0, 0.0: 0.0, 1.0: 45.0})


def atan2d(y: Column, x: Column) -> Column:
    """Angle of the point in degrees, exact on the axes and diagonals."""
    exact = F.when((y == 0) & (x > 0), 0.0).when((y == 0) & (x < 0), 180.0).when((x == 0) & (y > 0), 90.0).when((x == 0) & (y < 0), -90.0)
    return F.coalesce(exact, F.when((x == y) & (x > 0), 45.0).when((x == -y) & (x > 0), -45.0), F.degrees(F.atan2(y, x)))


def gcd(a: Column, b: Column, steps: int = 64) -> Column:
    """Greatest common divisor by Euclid's steps."""
    pair = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), pair,
        lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % F.when(p["y"] == 0, 1).otherwise(p["y"])).alias("y"))),
    )
    return done["x"]


def normal_rand(spark, n: int, mean: float, sd: float, seed: int):
    """n rows of normally distributed values."""
    return spark.range(n).select((F.randn(seed) * sd + mean).alias("value"))


# Number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_THOUSANDS = ("", " thousand", " million", " billion", " trillion", " quadrillion")
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()


def cash_words(c: Column) -> Column:
    """Dollars and cents in words, for any amount whose cents fit 64 bits."""
    ones, tens = F.array(*map(F.lit, _ONES)), F.array(*map(F.lit, _TENS))

    def below_hundred(n: Column) -> Column:
        return F.when(n < 20, F.get(ones, n)).when(n % 10 == 0, F.get(tens, (n / 10).cast("int"))).otherwise(
            F.concat(F.get(tens, (n / 10).cast("int")), F.lit(" "), F.get(ones, n % 10))
        )

    def below_thousand(n: Column) -> Column:
        h, r = F.floor(n / 100).cast("int"), n % 100
        hundreds = F.concat(F.get(ones, h), F.lit(" hundred"))
        return F.when(h == 0, below_hundred(r)).when(r == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" "), below_hundred(r)))

    cents = F.round(F.abs(c) * 100).cast("bigint")
    dollars = F.expr("0L") + (cents - cents % 100) / 100
    dollars = dollars.cast("bigint")
    groups, unit_of = [], dollars
    for name in _THOUSANDS:
        n = (unit_of % 1000).cast("int")
        groups.append(F.when(n > 0, F.concat(below_thousand(n), F.lit(name))))
        unit_of = ((unit_of - unit_of % 1000) / 1000).cast("bigint")
    words = F.when(dollars == 0, F.lit("zero")).otherwise(F.concat_ws(" ", *reversed(groups)))
    cc = (cents % 100).cast("int")
    unit = lambda n, w: F.when(n == 1, F.lit(w)).otherwise(F.lit(w + "s"))
    text = F.concat(words, F.lit(" "), unit(dollars, "dollar"), F.lit(" and "), below_hundred(cc), F.lit(" "), unit(cc, "cent"))
    text = F.when(c < 0, F.concat(F.lit("minus "), text)).otherwise(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000))
