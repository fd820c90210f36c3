"""Types, predicates, aggregates, statuses and the query description that parser and planner share."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from enum import Enum, IntEnum

from pyspark.sql import types as T


class Kind(str, Enum):
    U32, I64, F64, STR = "u32", "i64", "f64", "str"

    @property
    def spark(self) -> T.DataType:
        return {Kind.U32: T.LongType(), Kind.I64: T.LongType(), Kind.F64: T.DoubleType(), Kind.STR: T.StringType()}[self]


class Cmp(IntEnum):
    GT, GE, LT, LE, EQ, NE, BETWEEN = range(7)


class Agg(IntEnum):
    COUNT, SUM, MIN, MAX, AVG = range(5)


class Status(IntEnum):
    OK, UNKNOWN_COLUMN, INVALID_GROUP, TOO_MANY_GROUPS, UNSUPPORTED_TYPE, PARSE = range(6)


class QueryError(Exception):
    def __init__(self, status: Status, why: str = ""):
        super().__init__(f"{status.name}: {why}" if why else status.name)
        self.status = status


SYMBOLS = {">": Cmp.GT, ">=": Cmp.GE, "<": Cmp.LT, "<=": Cmp.LE, "=": Cmp.EQ, "!=": Cmp.NE}
U32_MAX, I64_MIN, I64_MAX = 2**32 - 1, -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Predicate:
    """column cmp low, or column BETWEEN low AND high (inclusive); bounds are text until a column types them."""

    column: str
    cmp: Cmp
    low: object
    high: object = None


@dataclass(frozen=True)
class Query:
    """One query. aggs: (aggregate, column), column None for COUNT(*); project: plain columns."""

    aggs: tuple[tuple[Agg, str | None], ...] = ()
    project: tuple[str, ...] = ()
    distinct: str | None = None
    where: Predicate | None = None
    group: str | None = None
    having: Predicate | None = None
    order: str | None = None
    limit: int | None = None
    join: tuple[str, str] | None = None
    dense: bool = False


def literal(kind: Kind, text: object) -> object:
    """A bound of the column's kind; PARSE if the text is not one."""
    bad = QueryError(Status.PARSE, f"{text!r} is not {kind.value}")
    if kind is Kind.STR:
        return str(text)
    if kind is Kind.F64:
        try:
            value = float(text)
        except ValueError:
            raise bad from None
        if "_" in str(text) or (math.isinf(value) and not re.fullmatch(r"[+-]?inf(inity)?", str(text), re.IGNORECASE)):
            raise bad
        return value
    if not re.fullmatch(r"[0-9]+" if kind is Kind.U32 else r"-?[0-9]+", str(text)):
        raise bad
    value = int(text)
    if not (0 <= value <= U32_MAX if kind is Kind.U32 else I64_MIN <= value <= I64_MAX):
        raise bad
    return value
