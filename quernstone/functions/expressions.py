"""Column expressions with the engine's rules for NaN, sentinels and overflow."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..model import Agg, Cmp, Kind, QueryError, Status


def matches(column: Column, kind: Kind, cmp: Cmp, low: object, high: object = None) -> Column:
    """The predicate; for doubles every comparison with NaN is false, save != which is true."""
    if kind is Kind.F64 and any(isinstance(x, float) and math.isnan(x) for x in (low, high)):
        return F.lit(cmp is Cmp.NE) & column.isNotNull()
    plain = {
        Cmp.GT: lambda: column > low,
        Cmp.GE: lambda: column >= low,
        Cmp.LT: lambda: column < low,
        Cmp.LE: lambda: column <= low,
        Cmp.EQ: lambda: column == low,
        Cmp.NE: lambda: column != low,
        Cmp.BETWEEN: lambda: column.between(low, high),
    }[cmp]()
    # Spark puts NaN above all numbers, so only the open upper side lets it in
    return plain & ~F.isnan(column) if kind is Kind.F64 and cmp in (Cmp.GT, Cmp.GE) else plain


def aggregate(agg: Agg, column: Column | None, kind: Kind | None, compat: bool = False) -> Column:
    """One aggregate. COUNT and SUM of nothing are 0; MIN, MAX and AVG of nothing are NULL, or with compat the
    sentinels of the kind (AVG: NaN). Integer sums raise on overflow."""
    if agg is Agg.COUNT:
        return F.count(F.lit(1) if column is None else column)
    if kind is Kind.STR and agg in (Agg.SUM, Agg.AVG):
        raise QueryError(Status.UNSUPPORTED_TYPE, f"{agg.name} of a string")
    if agg is Agg.SUM:
        return F.coalesce(F.sum(column), F.lit(0).cast("double" if kind is Kind.F64 else "long"))
    if agg is Agg.AVG:
        return F.coalesce(F.avg(column), F.lit(float("nan"))) if compat else F.avg(column)
    numbers = F.when(~F.isnan(column), column) if kind is Kind.F64 else column
    found = F.min(numbers) if agg is Agg.MIN else F.max(numbers)
    if not compat or kind is Kind.STR:
        return found
    sentinel = {
        (Kind.U32, Agg.MIN): "18446744073709551615BD", (Kind.U32, Agg.MAX): "0BD",
        (Kind.I64, Agg.MIN): "9223372036854775807L", (Kind.I64, Agg.MAX): "(-9223372036854775807L - 1L)",
        (Kind.F64, Agg.MIN): "double('Infinity')", (Kind.F64, Agg.MAX): "double('-Infinity')",
    }[kind, agg]
    return F.coalesce(found.cast("decimal(20,0)") if kind is Kind.U32 else found, F.expr(sentinel))


def count_distinct(column: Column, kind: Kind) -> Column:
    """Exact; NULL never counts and every NaN counts by itself."""
    if kind is not Kind.F64:
        return F.count_distinct(column)
    return F.count_distinct(F.when(~F.isnan(column), column)) + F.count_if(F.isnan(column))
