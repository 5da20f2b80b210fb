"""Column expressions for parsing, canonical pairs and portable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shuffle import GAMMA, MIX_A, MIX_B

#: What counts as white space around a field; the plain trim takes spaces only.
BLANKS = " \t\r\n\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def literal_split(c: Column, delimiter: str) -> Column:
    """Split at a literal delimiter, empty fields at the end included."""
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(c, quoted, -1)


def whole_number(c: Column) -> Column:
    """A 64-bit number in plain digits with an optional sign, else null."""
    return F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("bigint"))


def potential_pairs(n: str) -> Column:
    """All unordered pairs of the named count."""
    return F.expr(f"cast({n} * ({n} - 1) div 2 as bigint)")


# fixed values: the stored codes of behaviors
BEHAVIOR_CODES = {"buy": 1, "pv": 2}


def behavior_code(name: Column) -> Column:
    """The code of a behavior's name, null for one that has none."""
    out = F.lit(None).cast("tinyint")
    for known, code in BEHAVIOR_CODES.items():
        out = F.when(name == known, F.lit(code).cast("tinyint")).otherwise(out)
    return out


def behavior_name(code: Column) -> Column:
    """The name of a behavior's code; any other code, and none, is "unknown"."""
    out = F.lit("unknown")
    for name, known in BEHAVIOR_CODES.items():
        out = F.when(code == known, F.lit(name)).otherwise(out)
    return out


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def native_order(item: Column, behavior: Column, seed: int, user: Column) -> Column:
    """The hash that orders a group's users for bounded pairing, the same in any engine."""
    return F.md5(F.concat_ws("|", item.cast("string"), behavior, F.lit(str(seed)), user.cast("string")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The low half of 64 bits.
HALF = (1 << 32) - 1


def joined(high: Column, low: Column) -> Column:
    """64 bits of two halves, what is above their 32 bits carried or dropped."""
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(HALF)))


def plus(x: Column, constant: int) -> Column:
    """The sum in 64 bits; Spark's own raises an error beyond them."""
    return let(x.bitwiseAND(F.lit(HALF)) + (constant & HALF), lambda low: joined(F.shiftrightunsigned(x, 32) + (constant >> 32), low))


def times(x: Column, constant: int) -> Column:
    """The product in 64 bits: halves of ``x`` times sixteen bits of the constant each stay below 2**48."""
    part = [constant >> at & 0xFFFF for at in (0, 16, 32, 48)]

    def of_halves(low: Column, high: Column) -> Column:
        above = high * part[0] + F.shiftleft((high * part[1]).bitwiseAND(F.lit(0xFFFF)), 16)
        above = above + (low * part[2]).bitwiseAND(F.lit(HALF)) + F.shiftleft((low * part[3]).bitwiseAND(F.lit(0xFFFF)), 16)
        first, second = low * part[0], low * part[1]
        above = above + F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(second, 16)
        return let(first.bitwiseAND(F.lit(HALF)) + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16), lambda sum_: joined(above, sum_))

    return let(x.bitwiseAND(F.lit(HALF)), lambda low: let(F.shiftrightunsigned(x, 32), lambda high: of_halves(low, high)))


def folded(x: Column, bits: int) -> Column:
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def stable_hash_hex(value: Column, seed: int) -> Column:
    """The SplitMix64 output for value xor seed as 16 hex digits: text order is unsigned order."""
    x = let(value.cast("bigint").bitwiseXOR(F.lit(seed).cast("bigint")), lambda v: plus(v, GAMMA))
    x = let(folded(x, 30), lambda v: times(v, MIX_A))
    x = let(folded(x, 27), lambda v: times(v, MIX_B))
    return F.lower(F.lpad(F.hex(folded(x, 31)), 16, "0"))
