"""Scalar operators where Spark's own differ from the SQL that is wanted, and families to build them all."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short names of comparison operators.
COMPARE = {"gt": operator.gt, "ge": operator.ge, "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le}
INTEGERS = ("smallint", "int", "bigint")


def int_div(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Truncating integer division, in the operands' own type; dividing by zero is an error."""
    return F.call_function("div", a, b).cast(kind)


def divide(a: Column, b: Column, kind: str) -> Column:
    """Division that stays within a type: truncating on integers, unwidened on floats."""
    return int_div(a, b, kind) if kind in INTEGERS else (a / b).cast(kind)


def arithmetic(kind: str) -> dict:
    """The four operators within one type."""
    keep = lambda f: lambda a, b: f(a, b).cast(kind)
    return {"add": keep(operator.add), "sub": keep(operator.sub), "mul": keep(operator.mul), "div": lambda a, b: divide(a, b, kind)}


def common_type(a: str, b: str) -> str:
    """The type that operands of two numeric types meet in: the wider integer, else double, unless both are float."""
    if a in INTEGERS and b in INTEGERS:
        return max(a, b, key=INTEGERS.index)
    return "float" if a == b == "float" else "double"


def mixed_arithmetic(a: str, b: str) -> dict:
    """The four operators over operands of two numeric types."""
    kind = common_type(a, b)
    return {name: lambda x, y, f=f: f(x.cast(kind), y.cast(kind)) for name, f in arithmetic(kind).items()}


def compare_sign(a: Column, b) -> Column:
    """-1, 0 or 1; null if either is."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def midnight(day: Column) -> Column:
    return day.cast("date").cast("timestamp_ntz")


def day_at_most(moment: Column, limit: Column) -> Column:
    """Whether a timestamp's day is at most ``limit`` (a date, or a timestamp that the day's midnight is compared with).

    The column stands alone on its side, so a constant limit reaches the file scan; a cast of the column would not.
    """
    return moment < F.date_add(limit.cast("date"), 1).cast("timestamp_ntz")


def shift(moment: Column, amount: int, unit: str) -> Column:
    """A timestamp plus an interval; months clamp to the last day of the month."""
    return moment + F.expr(f"interval '{amount}' {unit}")


def date_shift(day: Column, amount: int, unit: str) -> Column:
    """A date plus an interval, as a timestamp."""
    return shift(midnight(day), amount, unit)
