"""Exact sums of doubles of any size, as mergeable integer limbs by exponent.

A double is scaled by its *bin*, floor(log2|x| / 32), and cut into four integer
limbs.  Limbs of one bin are summed as longs, so partial sums merge in any order,
and no finite double is too large, too small or too finely resolved.  Grouping by
the bin comes on top of the report's own keys; a group has one row per bin, of
which there are at most 67 and usually two.

``exact_value`` then adds the bins of a group: limbs become base-2**32 digits, a
carry runs from the lowest to the highest, and the digits are rounded to a double
once.  The result does not depend on partitions or row order.

Hours are written as decimals.  If a number of two, four, six or nine decimals lies
within the error that the inputs have as doubles (half a unit of the last place each),
and that error is far below the number's last digit, that number is the sum: three
times 0.333 is 0.999.  Every other sum is the exact one, rounded once.

Limbs of 23 and 21 bits leave room for 2**40 rows of one group and bin.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BIN_BITS = 32
DIGITS = ("d0", "d1", "d2", "d3")
HALF_ULP = 2.0 ** -53
WRITTEN_DECIMALS = (2, 4, 6, 9)
ROOM = 512.0                    # how many times the error must fit into the last decimal


def finite(c: Column) -> Column:
    """The value as a double; NULL for what is no finite number."""
    c = c.try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def bin_of(x: Column) -> Column:
    """Exponent bin of a finite double; NULL for 0 and NULL.

    The logarithm may miss a power of two by one bin; the limbs have room for that.
    """
    size = F.abs(x)
    return (F.when((size >= 1.0) & (size < float(1 << BIN_BITS)), F.lit(0))
             .when(size > 0.0, F.floor(F.log2(size) / F.lit(float(BIN_BITS))).cast("int")))


def scaled(x: Column, b: Column) -> Column:
    """A double's size in units of its bin, from a half to 2**33."""
    # scaled in two steps, as neither 2**1088 nor 2**-1088 is a double
    step = F.pow(F.lit(2.0), b * F.lit(-BIN_BITS // 2))
    return F.when(b == 0, F.abs(x)).otherwise(F.abs(x) * step * step)


def limb_columns(x: Column, y: Column) -> list[Column]:
    """Four signed integers: multiples of 2**10, 2**-11, 2**-32 and 2**-53 in units of the bin.

    ``y`` is the scaled size; give columns, as they are read many times."""
    sign = F.when(x < 0.0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    units, limbs = (2.0 ** 10, 2.0 ** -11, 2.0 ** -32, 2.0 ** -53), []
    rest = y
    for unit, finer in zip(units, (*units[1:], None)):
        limbs.append(F.floor(rest / F.lit(unit)).cast("long") * sign)
        if finer:
            rest = F.pmod(rest, F.lit(unit))        # exact: a remainder of doubles has no rounding
    return limbs


def digit_struct(b: Column, limbs: list[Column]) -> Column:
    """Summed limbs as digits at positions b - 2 to b + 1 (weights 2**(32 position))."""
    l0, l1, l2, l3 = limbs

    def low(c, bits):
        return c.bitwiseAND(F.lit((1 << bits) - 1))

    return F.struct(
        b.alias("b"),
        F.shiftleft(low(l3, 21), 11).alias("d0"),
        (F.shiftleft(low(l1, 11), 21) + low(l2, 32) + F.shiftright(l3, 21)).alias("d1"),
        (F.shiftleft(low(l0, 22), 10) + F.shiftright(l1, 11) + F.shiftright(l2, 32)).alias("d2"),
        F.shiftright(l0, 22).alias("d3"))


# Digits of a group (d0 to d3 of every bin) to its value, as SQL: each ``transform(array(x), v -> ..)[0]``
# names an intermediate value.
#   t: digits of all positions from low on, carried; a negative total ends with a carry of -1
#   g: the digits of its size (two's complement, if negative) and its sign
#   x: the position of the first digit other than 0, counted from low
#   v: the three digits from there, one bit for what follows (so the cast rounds once), and
#      the digits next to the point
_CARRIED = """aggregate({digits}, named_struct('carry', {start}L, 'out', cast(array() as array<bigint>)),
  (s, d) -> named_struct('carry', shiftright(s.carry + d, 32),
                         'out', concat(s.out, array((s.carry + d) & 4294967295L))))"""
_DIGITS = """transform(sequence(low, low + array_max(bins.b) - array_min(bins.b) + 5), p ->
  aggregate(bins, 0L, (t, s) -> t + coalesce(get(array(s.d0, s.d1, s.d2, s.d3), p - s.b + 2), 0L)))"""
_AT = "coalesce(get(x.digits, {}), 0L)"
_VALUE = f"""
get(transform(array(array_min(bins.b) - 2), low ->
get(transform(array({_CARRIED.format(digits=_DIGITS, start=0)}), t ->
get(transform(array(named_struct('sign', if(t.carry < 0, -1D, 1D), 'digits', if(t.carry < 0, {
    _CARRIED.format(digits="transform(t.out, d -> 4294967295L - d)", start=1)}.out, t.out))), g ->
get(transform(array(named_struct('sign', g.sign, 'digits', g.digits,
    'top', array_max(transform(g.digits, (d, i) -> if(d <> 0, i, null))))), x ->
get(transform(array(named_struct(
    'number', cast((cast({_AT.format("x.top")} as decimal(10,0)) * 4294967296BD * 4294967296BD
                    + cast({_AT.format("x.top - 1")} as decimal(10,0)) * 4294967296BD
                    + cast({_AT.format("x.top - 2")} as decimal(10,0))) * 2BD
                   + if(exists(slice(x.digits, 1, greatest(x.top - 2, 0)), d -> d <> 0), 1BD, 0BD) as double),
    'half', (low + x.top - 2) * 16,
    'whole', cast({_AT.format("1 - low")} as decimal(10,0)) * 4294967296BD + cast({_AT.format("0 - low")} as decimal(10,0)),
    'part', {_AT.format("-1 - low")} * {2.0 ** -32!r}D + {_AT.format("-2 - low")} * {2.0 ** -64!r}D,
    'error', rows * most * {HALF_ULP!r}D)), v ->
  x.sign * coalesce(
    get(transform(filter(array({", ".join(f"1e{k}D" for k in WRITTEN_DECIMALS)}), u ->
          low + x.top <= 1 and v.error * u < {1 / ROOM!r}D and abs(v.part * u - rint(v.part * u)) <= (v.error + v.part * {2 * HALF_ULP!r}D) * u
          and (v.whole > 0 or rint(v.part * u) > 0 or v.number * pow(2D, v.half - 1) * pow(2D, v.half) <= v.error)),
        u -> cast(cast(v.whole as decimal(20,0))
                  + cast(cast(rint(v.part * u) as decimal(10,0)) / cast(u as decimal(10,0)) as decimal(10,9)) as double)), 0),
    v.number * pow(2D, v.half) * pow(2D, v.half - 1), 0D)), 0)), 0)), 0)), 0)), 0)
"""


def exact_value(bins: str, rows: str, most: str) -> Column:
    """Sum of a group as a double.

    ``bins``: the column of its ``digit_struct`` values, in any order; ``rows`` and
    ``most``: how many values were added, and the largest size among them.  No bins
    give 0.
    """
    names = {"bins": bins, "rows": rows, "most": most}
    text = re.sub(r"\b(bins|rows|most)\b", lambda m: f"`{names[m[0]]}`", _VALUE)
    return F.when(F.size(bins) > 0, F.expr(text)).otherwise(F.lit(0.0))


def snapped(total: Column, rows: int, most: Column) -> Column:
    """The same for a plain sum of very few doubles, which is free of order already."""
    out, error = total, most * F.lit(2 * rows * HALF_ULP)
    for k in reversed(WRITTEN_DECIMALS):
        written = F.round(F.when(F.abs(total) < F.lit(1e15), total).cast("decimal(38,18)"), k).cast("double")
        out = F.when((error < 10.0 ** -k / ROOM) & (F.abs(total - written) <= error), written).otherwise(out)
    return out
