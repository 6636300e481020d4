"""Integers in binary columns, with built-in functions only.

``reverse`` of a binary column reverses characters, so little-endian fields are read by swapping
pairs of hex digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands once in the plan, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def le(value: Column, size: int) -> Column:
    """A non-negative number as ``size`` bytes, lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return let(digits, lambda d: F.unhex(F.concat(*[F.substring(d, 2 * (size - k) - 1, 2) for k in range(size)])))


def be(value: Column, size: int) -> Column:
    """A non-negative number as ``size`` bytes, highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def read_le(data: Column, at: Column | int, size: int) -> Column:
    """The number of ``size`` bytes (seven at most) at place ``at``, counted from 1."""
    at = F.lit(at) if isinstance(at, int) else at
    swapped = lambda d: F.concat(*[F.substring(d, 2 * (size - k) - 1, 2) for k in range(size)])
    return let(F.hex(F.substring(data, at, F.lit(size))), lambda d: F.when(F.length(d) == 2 * size, F.conv(swapped(d), 16, 10).cast("bigint")))


def joined(parts: Column) -> Column:
    """The bytes of an array of binaries, one after the other: by hex digits, which join without a copy per part."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def read_be(data: Column) -> Column:
    """All bytes as one number of up to 64 unsigned bits; 0 without bytes, null beyond eight bytes."""
    return F.when(F.octet_length(data) == 0, F.lit(0).cast("decimal(20,0)")).when(F.octet_length(data) <= 8, F.conv(F.hex(data), 16, 10).cast("decimal(20,0)"))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")
