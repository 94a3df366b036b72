"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_US = 86_400 * MICROS

# Numbers that devices write in place of a measurement.
POWER_STAND_INS = (-1.0, -999.0, 65535.0, 999999.0)
TEMPERATURE_STAND_INS = (-99.9, -127.0, 85.0, 999.9)

# Fixed value: watts that no household connection delivers.
CONNECTION_LIMIT_W = 100_000.0


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a naive timestamp (the session time zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_to(us: Column, width_us: int) -> Column:
    """Start of the cell of ``width_us`` that contains ``us``; exact in integers, also before 1970."""
    return us - F.pmod(us, F.lit(width_us).cast("bigint"))


def canonical_id(c: str | Column) -> Column:
    """The usual form of an id: its letters and digits in upper case; null when there are none."""
    kept = F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\p{L}\p{Nd}]", ""))
    return F.when(kept != "", kept)


def measured(c: Column, stand_ins: Sequence[float] = ()) -> Column:
    """The value where it is a measurement: null for null, NaN and the device's stand-in numbers. Infinite values stay."""
    known = c.isNotNull() & ~F.isnan(c)
    if stand_ins:
        known = known & ~c.isin(*[float(x) for x in stand_ins])
    return F.when(known, c)


def split_name(c: str | Column) -> Column:
    """train, validation or test for any spelling (full or shortened, case, blanks); null for anything else."""
    s = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(s.startswith("tr"), "train").when(s.startswith("va"), "validation").when(s.startswith("te"), "test")
