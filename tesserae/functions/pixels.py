"""Block arrays, their top six bit planes and the two low planes that carry a payload.

A block is ``px array<int>`` in raster order, values 0..255.  With side B it has
B*B pixels; two low bits each give 2*B*B payload bits, the first of a pair
having weight 2.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Payload split per block side -> (capacity, tag, backup) in bits.
BUDGET = {8: (128, 32, 96), 4: (32, 16, 16)}

def budget(block: int) -> tuple[int, int, int]:
    return BUDGET[block]


def msb(px: Column) -> Column:
    return F.transform(px, lambda v: v.bitwiseAND(252))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column used inside an array lambda may be inlined there by the optimizer and then
    run once per element; binding it as the element of a one-element array prevents that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def to_bytes(values: Column) -> Column:
    """array<int> of 0..255 -> binary."""
    return F.encode(F.array_join(F.transform(values, lambda v: F.char(v.cast("bigint"))), ""), "ISO-8859-1")


def from_bytes(data: Column) -> Column:
    """binary -> array<int> of 0..255."""
    return F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.ascii(c))


def msb_bytes(px: Column) -> Column:
    return to_bytes(msb(px))


def payload(px: Column, block: int) -> Column:
    """The bytes held in the two low bits of a block."""

    def read(x):
        def byte(k):
            pair = lambda j: F.element_at(x, (k * 4 + j + 1).cast("int")).bitwiseAND(3)
            return pair(0) * 64 + pair(1) * 16 + pair(2) * 4 + pair(3)

        return to_bytes(F.transform(F.sequence(F.lit(0), F.lit(block * block // 4 - 1)), byte))

    return let(px, read)


def with_payload(px: Column, data: Column) -> Column:
    """Write payload bytes into the two low bits; the upper six bits are untouched."""

    def write(low):
        def pixel(v, p):
            byte = F.element_at(low, F.shiftright(p, 2) + 1)
            pair = F.floor(byte / F.element_at(F.array(*[F.lit(s) for s in (64, 16, 4, 1)]), p % 4 + 1)).cast("int")
            return v.bitwiseAND(252).bitwiseOR(pair.bitwiseAND(3))

        return F.transform(px, pixel)

    return let(from_bytes(data), write)


def squared_error(a: Column, b: Column) -> Column:
    """Sum of squared differences of two equally long arrays, exact in bigint."""
    diffs = F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("bigint"))
    return F.aggregate(diffs, F.lit(0).cast("bigint"), lambda s, d: s + d)


def psnr(sum_sq: Column, count: Column) -> Column:
    """10*log10(255^2/MSE); +inf for identical input, NaN for no pixels at all."""
    return (
        F.when(count == 0, F.lit(float("nan")))
        .when(sum_sq == 0, F.lit(float("inf")))
        .otherwise(10.0 * F.log10(F.lit(65025.0) * count / F.when(sum_sq == 0, F.lit(1)).otherwise(sum_sq)))
    )
