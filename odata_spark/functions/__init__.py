"""Scalar functions of the query language as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Unsupported, ValidationError

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def arithmetic(op: str, a: Column, b: Column, integral: bool) -> Column:
    """Division by zero gives null; div of whole numbers is whole and truncates, divby never is."""
    if op == "add":
        return a + b
    if op == "sub":
        return a - b
    if op == "mul":
        return a * b
    if op == "mod":
        return F.try_mod(a, b)
    if op == "div" and integral:
        return F.call_function("div", a, F.nullif(b, F.lit(0)))  # exact beyond 2 ** 53
    return F.try_divide(a.cast("double"), b.cast("double"))


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    return F.substr(s, start.cast("int") + 1, n.cast("int")) if n is not None else F.substr(s, start.cast("int") + 1)


#: Name -> (builder over columns, result type or None for the argument's).
SCALAR = {
    "contains": (lambda s, v: s.contains(v), "boolean"),
    "startswith": (lambda s, v: s.startswith(v), "boolean"),
    "endswith": (lambda s, v: s.endswith(v), "boolean"),
    "matchesPattern": (lambda s, v: F.regexp_like(s, v), "boolean"),
    "length": (F.length, "int"),
    "tolower": (F.lower, "string"),
    "toupper": (F.upper, "string"),
    "trim": (F.trim, "string"),
    "indexof": (lambda s, v: F.call_function("instr", s, v) - 1, "int"),
    "substring": (_substring, "string"),
    "concat": (lambda a, b: F.concat(a.cast("string"), b.cast("string")), "string"),
    "year": (F.year, "int"),
    "month": (F.month, "int"),
    "day": (F.dayofmonth, "int"),
    "hour": (F.hour, "int"),
    "minute": (F.minute, "int"),
    "second": (F.second, "int"),
    "fractionalseconds": (lambda t: F.date_part(F.lit("seconds"), t) % 1, "decimal"),
    "date": (F.to_date, "date"),
    "time": (lambda t: F.date_format(t, "HH:mm:ss"), "string"),
    "now": (lambda: F.current_timestamp().cast("timestamp_ntz"), "timestamp_ntz"),
    "mindatetime": (lambda: F.lit("0001-01-01T00:00:00").cast("timestamp_ntz"), "timestamp_ntz"),
    "maxdatetime": (lambda: F.lit("9999-12-31T23:59:59").cast("timestamp_ntz"), "timestamp_ntz"),
    "totaloffsetminutes": (lambda t: F.when(t.isNotNull(), 0), "int"),
    "round": (lambda x: F.round(x), None),
    "floor": (F.floor, "bigint"),
    "ceiling": (F.ceil, "bigint"),
}


def call(name: str, args: list[Column]) -> Column:
    if name not in SCALAR:
        raise Unsupported(f"{name} is not supported")
    try:
        return SCALAR[name][0](*args)
    except TypeError as e:
        raise ValidationError(f"bad arguments of {name}") from e
