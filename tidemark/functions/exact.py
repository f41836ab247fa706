"""Exact sums: integers and their averages beyond 38 digits by signed base-10**9 limbs, doubles by bins of their exponents.

All of it is built-in column expressions; nothing goes to Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 5


def parts(x: Column) -> tuple[Column, Column]:
    """An integer taken apart: 64 bits, if they hold it, else a sign and 45 digits as text."""
    x, most = x.cast("decimal(38,0)"), F.lit("9" * 18).cast("decimal(18,0)")
    fits = (x <= most) & (x >= -most)
    # The sign goes from the text: abs() rounds decimals to 34 digits.
    text = F.concat(F.when(x < 0, "-").otherwise("+"), F.lpad(F.ltrim(x.cast("string"), F.lit("-")), 45, "0"))
    return F.when(fits, x.cast("bigint")), F.when(~fits, text)


def _limb_of(small: Column, text: Column, i: int) -> Column:
    # Towards zero, quotients and remainders keep the sign.
    value = small
    for _ in range(i):
        value = _div(value, F.lit(10**9))
    if i < LIMBS - 1:
        value = value % 10**9
    wide = F.substring(text, 46 - 9 * (i + 1) + 1, 9).cast("bigint")
    return F.when(small.isNotNull(), value).otherwise(F.when(text.startswith("-"), -wide).otherwise(wide)).cast("decimal(18,0)")


def limb(x: Column, i: int) -> Column:
    """The i-th signed base-10**9 limb of an integer, the lowest first."""
    return _limb_of(*parts(x), i)


def limb_sums(x: Column | tuple[Column, Column], prefix: str) -> list[Column]:
    """Aggregates of all limbs of an integer, or of its ``parts``; they merge by addition and cannot overflow in part."""
    return [F.sum(_limb_of(*(x if isinstance(x, tuple) else parts(x)), i)).alias(f"{prefix}{i}") for i in range(LIMBS)]


def finish_sum(limbs: list[Column]) -> Column:
    """The sum as decimal(38,0), null for no values; only the final total can overflow, which is an error."""
    base = F.lit("1" + "0" * 9).cast("decimal(10,0)")
    wide = "decimal(38,0)"
    # A fold keeps the expression small: each step's carry is bound once, not written into the next one.
    start = F.struct(F.lit(0).cast(wide).alias("carry"), F.lit(0).cast(wide).alias("rest"), F.lit(1).cast(wide).alias("unit"))

    def step(s: Column, limb: Column) -> Column:
        value = (limb + s["carry"]).cast(wide)
        digit = F.pmod(value, base).cast(wide)
        return F.struct(((value - digit) / base).cast(wide).alias("carry"), (s["rest"] + digit * s["unit"]).cast(wide).alias("rest"), (s["unit"] * base).cast(wide).alias("unit"))

    def whole(s: Column) -> Column:
        top, rest, unit = (limbs[LIMBS - 1] + s["carry"]).cast(wide), s["rest"], s["unit"]
        fits = (top < 100) & ((top > -100) | ((top == -100) & (rest > 0)))
        up = (top.cast("decimal(3,0)") * unit.cast("decimal(37,0)") + rest).cast(wide)
        down = ((top + 1).cast("decimal(3,0)") * unit.cast("decimal(37,0)") - (unit - rest)).cast(wide)
        overflow = F.raise_error(F.lit("the integer sum has more than 38 digits")).cast(wide)
        return F.when(top.isNull(), F.lit(None).cast(wide)).when(~fits, overflow).when(top >= 0, up).otherwise(down)

    return F.aggregate(F.array(*(x.cast(wide) for x in limbs[: LIMBS - 1])), start, step, whole)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _div(a: Column, b: Column) -> Column:
    """Integer division towards zero, exact for decimals; the quotient has 64 bits."""
    return F.call_function("div", a, b)


def _carried(limbs: Column, base: int) -> Column:
    """Limbs, lowest first, with all but the highest between 0 and ``base`` - 1: array<decimal(38,0)>; the highest keeps the sign."""
    wide, unit = "decimal(38,0)", F.lit(base).cast("decimal(38,0)")
    start = F.struct(F.lit(0).cast(wide).alias("carry"), F.array().cast(f"array<{wide}>").alias("done"))

    def step(s: Column, limb: Column) -> Column:
        def split(value: Column) -> Column:
            digit = F.pmod(value, unit).cast(wide)
            return F.struct(_div(value - digit, unit).cast(wide).alias("carry"), F.concat(s["done"], F.array(digit)).alias("done"))

        return _let((limb + s["carry"]).cast(wide), split)

    lower = F.slice(limbs, F.lit(1), F.size(limbs) - 1)
    return F.aggregate(lower, start, step, lambda s: F.concat(s["done"], F.array((F.element_at(limbs, -1) + s["carry"]).cast(wide))))


def _quotient(count: Column, limbs: list[Column], places: int) -> Column:
    """(negative, digits, rest, count): the magnitude of the limbs' number over ``count``, in base-10**9 digits from the highest, ``places`` of them after the point."""
    wide = "decimal(38,0)"
    plain = F.array(*(x.cast(wide) for x in limbs))
    n = count.cast(wide)

    def of(signed: Column) -> Column:
        negative = F.element_at(signed, -1) < 0
        digits = F.when(negative, _carried(F.transform(plain, lambda x: (-x).cast(wide)), 10**9)).otherwise(signed)
        down = F.concat(F.reverse(digits), F.array_repeat(F.lit(0).cast(wide), places))
        start = F.struct(F.array().cast("array<bigint>").alias("digits"), F.lit(0).cast(wide).alias("rest"))

        def step(s: Column, d: Column) -> Column:
            return _let((s["rest"] * F.lit(10**9).cast("decimal(10,0)") + d).cast(wide), lambda v: F.struct(F.concat(s["digits"], F.array(_div(v, n))).alias("digits"), (v % n).cast(wide).alias("rest")))

        return F.aggregate(down, start, step, lambda s: F.struct(negative.alias("negative"), s["digits"].alias("digits"), s["rest"].alias("rest")))

    return F.when((count > 0) & ~F.exists(plain, lambda x: x.isNull()), _let(_carried(plain, 10**9), of))


def exact_average(count: Column, *limbs: Column) -> Column:
    """The limbs' number over ``count`` as text, scale 9, half-even: long division, column by column. Null for no values."""

    def text(q: Column) -> Column:
        twice = (q["rest"] * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")
        up = (twice > count) | ((twice == count) & (F.element_at(q["digits"], -1) % 2 == 1))
        start = F.struct(up.cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("done"))
        # The highest digit stands alone: only those below it can overflow into the next.
        low = F.slice(F.reverse(q["digits"]), F.lit(1), F.size(q["digits"]) - 1)
        step = lambda s, d: F.struct(F.when(d + s["carry"] == 10**9, 1).otherwise(0).cast("bigint").alias("carry"), F.concat(F.array((d + s["carry"]) % 10**9), s["done"]).alias("done"))
        rounded = F.aggregate(low, start, step, lambda s: F.concat(F.array(F.get(q["digits"], F.lit(0)) + s["carry"]), s["done"]))

        def written(d: Column) -> Column:
            padded = F.transform(d, lambda x: F.lpad(x.cast("string"), F.greatest(F.lit(9), F.length(x.cast("string"))), F.lit("0")))
            whole = F.ltrim(F.array_join(F.slice(padded, F.lit(1), F.size(d) - 1), ""), F.lit("0"))
            sign = F.when(q["negative"] & F.exists(d, lambda x: x > 0), "-").otherwise("")
            return F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.lit("."), F.element_at(padded, -1))

        return _let(rounded, written)

    return _let(_quotient(count, list(limbs), 1), lambda q: F.when(q.isNotNull(), text(q)))


def average_order(count: Column, *limbs: Column) -> Column:
    """An array that sorts as the exact rational average: 45 digits after the point tell any two averages apart. Null for no values."""
    signed = lambda q: F.transform(q["digits"], lambda d: F.when(q["negative"], -d).otherwise(d))
    return _let(_quotient(count, list(limbs), 5), lambda q: F.when(q.isNotNull(), signed(q)))


# --- doubles -------------------------------------------------------------------------------------

#: Bits of a bin; a double spans four bins at most.
BIN = 24
PIECES = 4


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def double_bin(x: Column) -> Column:
    """The bin of a double's highest bits: about its exponent over ``BIN``. 0 for zero; null for null and non-finite values."""
    return F.when(x == 0, 0).when(_finite(x), F.floor(F.log2(F.abs(x)) / BIN)).cast("int")


def double_pieces(x: Column) -> list[Column]:
    """The integers that a finite double has in its bin and the three below: together they are the double, exactly."""
    # Powers of two, and remainders, lose no bits; half the power at a time stays within the range of doubles.
    half = F.pow(F.lit(2.0), F.lit(-BIN // 2) * double_bin(x))
    part, out = F.when(_finite(x), x * half * half), []
    for _ in range(PIECES):
        out.append(part.cast("bigint"))
        part = (part % F.lit(1.0)) * F.lit(2.0**BIN)
    return out


def finish_double(bins: Column) -> Column:
    """The sum of array<struct<bin, p0, p1, p2, p3>>, rounded once to the nearest double; an error beyond the largest one. Null for no bins.

    Integers of equal place are added, carries go up from the lowest place, and the
    highest bits with a mark for what is below them become the double.
    """
    wide = "decimal(38,0)"
    placed = F.flatten(F.transform(bins, lambda b: F.array(*(F.struct((b["bin"] - j).alias("at"), b[f"p{j}"].cast(wide).alias("n")) for j in range(PIECES)))))

    def total(entries: Column) -> Column:
        low, high = F.array_min(F.transform(entries, lambda e: e["at"])), F.array_max(F.transform(entries, lambda e: e["at"]))
        # Room above for sums of 38 digits, so that the highest limb holds nothing but the sign.
        places = F.sequence(low, high + 7)
        at = lambda i: F.aggregate(F.filter(entries, lambda e: e["at"] == i), F.lit(0).cast(wide), lambda s, e: (s + e["n"]).cast(wide))

        def rounded(limbs: Column) -> Column:
            def magnitude(signed: Column) -> Column:
                negative = F.element_at(signed, -1) < 0
                digits = F.when(negative, _carried(F.transform(limbs, lambda x: (-x).cast(wide)), 1 << BIN)).otherwise(signed)

                def top(down: Column) -> Column:
                    first = F.array_position(F.transform(down, lambda d: d > 0), True).cast("int")
                    four = [F.coalesce(F.get(down, first - 1 + j), F.lit(0).cast(wide)) for j in range(4)]
                    unit, n = F.lit(1 << BIN).cast("decimal(8,0)"), four[0]
                    for d in four[1:]:
                        n = (n * unit + d).cast(wide)
                    below = F.exists(F.slice(down, first + 4, F.size(down)), lambda d: d > 0)
                    whole = (n * F.lit(2).cast("decimal(1,0)") + below.cast("int").cast("decimal(1,0)")).cast(wide).cast("double")
                    power = (high + 7 - (first - 1) - 3) * BIN - 1
                    value = whole * F.pow(F.lit(2.0), F.floor(power / 2)) * F.pow(F.lit(2.0), power - F.floor(power / 2))
                    fits = F.when(F.abs(value) < float("inf"), value).otherwise(F.raise_error(F.lit("the sum of doubles is not finite")).cast("double"))
                    return F.when(first == 0, F.lit(0.0)).otherwise(F.when(negative, -fits).otherwise(fits))

                return _let(F.reverse(digits), top)

            return _let(_carried(limbs, 1 << BIN), magnitude)

        return _let(F.transform(places, at), rounded)

    return F.when(F.size(bins) > 0, _let(placed, total))
