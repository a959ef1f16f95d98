"""Encoders: they define equality and order of a column's values.

Canonical encoders are the identity on a Spark type whose order is the wanted one, so filters reach the Parquet scan. A custom
encoder is an expression that both the column and the literal go through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EncodeError

RESERVED = ("keyloom/column/", "keyloom/multi/", "keyloom/cover/")


@dataclass(frozen=True)
class Encoder:
    """``apply`` maps a Spark column to its comparison form; ``check`` rejects values without one."""

    id: str
    apply: Callable[[Column], Column] = lambda c: c
    check: Callable[[Any], bool] = lambda v: True

    def literal(self, value: Any) -> Column:
        if value is None or not self.check(value):
            raise EncodeError(f"{self.id}: {value!r}")
        return self.apply(F.lit(value))


def _int(bits: int, signed: bool) -> Callable[[Any], bool]:
    lo, hi = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and lo <= v <= hi


NATURAL = Encoder("natural")
STRING = Encoder("string", check=lambda v: isinstance(v, str))
BYTES = Encoder("bytes", check=lambda v: isinstance(v, (bytes, bytearray)))
INT32 = Encoder("int32", check=_int(32, True))
INT64 = Encoder("int64", check=_int(64, True))
UINT32 = Encoder("uint32", check=_int(32, False))
UINT64 = Encoder("uint64", lambda c: c.cast("decimal(20,0)"), _int(64, False))
TIME = Encoder("time")
UUID = Encoder("uuid", check=lambda v: isinstance(v, (bytes, bytearray)) and len(v) == 16)
FLOAT32 = Encoder("float32", lambda c: c.cast("float"))
#: Case-folding text: equal if equal in lower case.
FOLD = Encoder("fold", F.lower, lambda v: isinstance(v, str))
#: Doubles by their bits: NaN equals NaN, and -0.0 is below 0.0 and not equal to it.
FLOAT_BITS = Encoder("float-bits", lambda c: F.struct(c.cast("double").alias("v"), F.when(c.cast("string") == "-0.0", -1).otherwise(0).alias("s")))


def int64_bytes(c: Column) -> Column:
    """Eight big-endian bytes with the sign bit flipped: byte order is value order."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def bytes_int64(c: Column) -> Column:
    return F.conv(F.hex(c), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def uint32_bytes(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))


def sortable_tuple(*parts: Column) -> Column:
    """One binary key whose byte order is the tuples' order: zero bytes are escaped and each part is terminated."""
    ends = [F.concat(F.regexp_replace(F.regexp_replace(F.hex(p.cast("binary")), "(..)", "$1 "), "00 ", "00FF "), F.lit("0000")) for p in parts]
    return F.unhex(F.regexp_replace(F.concat(*ends), " ", ""))
