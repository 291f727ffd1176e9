"""Integer hashes, powers of two, curve keys and guarded reciprocals. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two integer hashes: the constant of each step, and its shift.
_HASH32 = ((0x7ED55D16, 12), (0xC761C23C, 19), (0x165667B1, 5), (0xD3A2646C, 9), (0xFD7046C5, 3), (0xB55A4F09, 16))
_HASH64 = ((0x7ED55D166BEF7A1D, 12), (0xC761C23C510FA2DD, 9), (0x165667B183A9C0E1, 59), (0xD3A2646CAB3487E3, 49), (0xFD7046C5EF9AB54C, 3), (0xB55A4F090DD4A67B, 32))
_LOW32 = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _wrapped_sum(a: Column, b: Column) -> Column:
    """a + b modulo 2**64: halves are added apart, for ANSI mode raises on overflow."""
    low = a.bitwiseAND(_LOW32) + b.bitwiseAND(_LOW32)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW32))


def hash_unsigned(a: Column) -> Column:
    """32-bit integer hash of the low 32 bits, as a long from 0 to 2**32 - 1."""

    def step(a: Column, i: int) -> Column:
        c, s = _HASH32[i]
        left = F.shiftleft(a, s)
        if i in (0, 2, 4):
            return (a + c + left).bitwiseAND(_LOW32)
        if i == 3:
            return (a + c).bitwiseXOR(left).bitwiseAND(_LOW32)
        return a.bitwiseXOR(F.lit(c)).bitwiseXOR(F.shiftrightunsigned(a, s)).bitwiseAND(_LOW32)

    return F.transform(F.array(a.cast("long").bitwiseAND(_LOW32)), lambda x: _chain(x, step))[0]


def hash_long(a: Column) -> Column:
    """64-bit integer hash; the result is the signed long with the same bits."""

    def step(a: Column, i: int) -> Column:
        c, s = _HASH64[i]
        c = F.lit(_signed(c)).cast("long")
        if i in (0, 2, 4):
            return _wrapped_sum(_wrapped_sum(a, c), F.shiftleft(a, s))
        if i == 3:
            return _wrapped_sum(a, c).bitwiseXOR(F.shiftleft(a, s))
        return a.bitwiseXOR(c).bitwiseXOR(F.shiftrightunsigned(a, s))

    return F.transform(F.array(a.cast("long")), lambda x: _chain(x, step))[0]


def _chain(x: Column, step) -> Column:
    """Six steps, each computed once: an array of one element is mapped again and again."""
    done = reduce(lambda acc, i: F.transform(acc, lambda y: step(y, i)), range(6), F.array(x))
    return done[0]


def round_up_pow2(n: Column) -> Column:
    """The least power of two not below n (n >= 1)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(n <= 1, 0).otherwise(F.length(F.bin(n.cast("long") - 1))).cast("int"))


def reciprocal(x: Column) -> Column:
    """1 / x; null for 0."""
    return F.when(x != 0, 1 / x)


def hilbert_key(x: Column, y: Column, bits: int) -> Column:
    """Place of (x, y) on the Hilbert curve over a square of 2**bits, bits <= 31; points outside the square are an error."""
    if not 1 <= bits <= 31:
        raise ValueError("bits must be from 1 to 31")

    def step(acc: Column, level: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
        rx = F.when(acc["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        ry = F.when(acc["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        quarter = (3 * rx).bitwiseXOR(ry)
        low = side - 1
        lx, ly = acc["x"].bitwiseAND(low), acc["y"].bitwiseAND(low)
        turn, flip = ry == 0, (ry == 0) & (rx == 1)
        nx = F.when(flip, low - ly).when(turn, ly).otherwise(lx)
        ny = F.when(flip, low - lx).when(turn, lx).otherwise(ly)
        return F.struct(nx.alias("x"), ny.alias("y"), (acc["d"] * 4 + quarter).alias("d"))

    def inside(c: Column) -> Column:
        c = c.cast("long")
        return F.when((c < 0) | (c >= 1 << bits), F.raise_error(F.lit(f"id outside the square of 2**{bits}")).cast("long")).otherwise(c)

    first = F.struct(inside(x).alias("x"), inside(y).alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), first, step, lambda a: a["d"])
