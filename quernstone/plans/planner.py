"""Query to DataFrame. Everything after binding is Catalyst's: pushdown, pruning, partial aggregation, top-n."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..catalog import RID, Catalog, Column
from ..functions.expressions import aggregate, count_distinct, matches
from ..model import Agg, Cmp, Kind, Predicate, Query, QueryError, Status, literal
from ..operators.groups import dense_groups
from ..operators.joins import join_count, join_rows
from .grammar import parse

GROUP_CAP, JOIN_ROWS = 1 << 28, 100


def title(agg: Agg, column: str | None) -> str:
    return f"{agg.name.lower()}_{column}" if column else agg.name.lower()


class Planner:
    """group_cap: the most groups by the largest key that are admitted. Dense groups always have a cap; other groups
    take no room for absent keys, so their keys are looked at beforehand only where a cap was set."""

    def __init__(self, catalog: Catalog, group_cap: int | None = None, compat: bool = False):
        self.catalog, self.group_cap, self.compat = catalog, group_cap, compat

    def sql(self, text: str) -> DataFrame:
        return self.plan(parse(text))

    def plan(self, query: Query) -> DataFrame:
        if query.join:
            return self._join(query)
        if query.distinct:
            column = self.catalog.column(query.distinct)
            return self.catalog.frame_for(column).agg(count_distinct(F.col(f"`{column.name}`"), column.kind).alias(f"count_distinct_{column.name}"))
        return self._aggregate(query) if query.aggs else self._project(query)

    def _bound(self, where: Predicate, kind: Kind) -> Predicate:
        high = literal(kind, where.high) if where.cmp is Cmp.BETWEEN else None
        return replace(where, low=literal(kind, where.low), high=high)

    def _filtered(self, frame: DataFrame, query: Query) -> DataFrame:
        if not query.where:
            return frame
        column = self.catalog.column(query.where.column)
        bound = self._bound(query.where, column.kind)
        return frame.where(matches(F.col(f"`{column.name}`"), column.kind, bound.cmp, bound.low, bound.high))

    def _project(self, query: Query) -> DataFrame:
        shown = self.catalog.column(query.project[0])
        used = [shown] + ([self.catalog.column(query.where.column)] if query.where else [])
        frame = self._filtered(self.catalog.frame_for(*used, numbers=True), query)
        ordered = frame.orderBy(RID)
        return (ordered if query.limit is None else ordered.limit(query.limit)).select(f"`{shown.name}`")

    def _terms(self, query: Query) -> list:
        terms = []
        for agg, name in query.aggs:
            column = self.catalog.column(name)
            terms.append(aggregate(agg, F.col(f"`{name}`"), column.kind, self.compat).alias(title(agg, name)))
        return terms

    def _aggregate(self, query: Query) -> DataFrame:
        values = [self.catalog.column(name) for _, name in query.aggs]
        filtered = [self.catalog.column(query.where.column)] if query.where else []
        terms = self._terms(query)
        if not query.group:
            return self._filtered(self.catalog.frame_for(*values, *filtered), query).agg(*terms)
        key = self._key(query.group, values)
        frame = self._filtered(self.catalog.frame_for(*values, *filtered, key), query)
        grouped = frame.where(F.col(f"`{key.name}`").isNotNull()).groupBy(f"`{key.name}`").agg(*terms)
        if query.dense:
            grouped = dense_groups(grouped, key.name, self._groups(key), [title(a, c) for a, c in query.aggs if a in (Agg.COUNT, Agg.SUM)])
        return self._after_groups(grouped, query, key.name)

    def _key(self, name: str, values: list[Column]) -> Column:
        key = self.catalog.column(name)
        if key.kind not in (Kind.U32, Kind.STR):
            raise QueryError(Status.PARSE, f"GROUP BY {name}: the key is {key.kind.value}")
        if any(v.name == name for v in values):
            raise QueryError(Status.INVALID_GROUP, f"{name} is key and value")
        if key.kind is Kind.U32 and self.group_cap is not None:
            self._groups(key)
        return key

    def _groups(self, key: Column) -> int:
        """Groups by the largest key of all rows; more than the cap are not admitted."""
        if key.kind is Kind.STR:
            raise QueryError(Status.UNSUPPORTED_TYPE, "dense groups need a u32 key")
        largest = self.catalog.frame_for(key).agg(F.max(f"`{key.name}`")).first()[0]
        groups = 0 if largest is None else largest + 1
        if groups > (GROUP_CAP if self.group_cap is None else self.group_cap):
            raise QueryError(Status.TOO_MANY_GROUPS, f"{groups} groups")
        return groups

    def _after_groups(self, grouped: DataFrame, query: Query, key: str) -> DataFrame:
        names = {title(a, c): (a, c) for a, c in query.aggs}

        def target(name: str) -> str:
            for shown, (agg, column) in names.items():
                if name.upper() == agg.name or name == column:
                    return shown
            return next(iter(names))

        if query.having:
            shown = target(query.having.column)
            agg, column = names[shown]
            kind = Kind.F64 if agg is Agg.AVG else Kind.I64 if agg is Agg.COUNT else self.catalog.column(column).kind
            number = Kind.F64 if kind is not Kind.STR else kind
            exact = number if any("." in str(x) for x in (query.having.low, query.having.high) if x is not None) or kind is Kind.F64 else (kind if kind is Kind.STR else Kind.I64)
            bound = self._bound(query.having, exact)
            grouped = grouped.where(matches(F.col(f"`{shown}`"), Kind.F64 if kind is Kind.F64 else Kind.I64, bound.cmp, bound.low, bound.high))
        if query.order:
            return grouped.orderBy(F.col(f"`{target(query.order)}`").desc(), F.col(f"`{key}`")).limit(query.limit)
        return grouped.orderBy(f"`{key}`")

    def _join(self, query: Query) -> DataFrame:
        left, right = (self.catalog.column(c) for c in query.join)
        if Kind.STR in (left.kind, right.kind) or Kind.F64 in (left.kind, right.kind) or left.kind is not right.kind:
            raise QueryError(Status.UNSUPPORTED_TYPE, "join keys must both be u32 or both i64")
        if query.aggs and query.aggs[0][1] is None:
            return join_count(self.catalog.frame_for(left), left.name, self.catalog.frame_for(right), right.name).withColumnRenamed("n", "count")
        if query.project:
            shown = [self.catalog.column(c) for c in query.project]
            sides = [self.catalog.frame_for(k, c, numbers=True) for k, c in zip((left, right), shown, strict=True)]
            rows = join_rows(sides[0], left.name, sides[1], right.name, *query.project)
            return rows.limit(JOIN_ROWS if query.limit is None else query.limit)
        (agg, name), = query.aggs
        value = self.catalog.column(name)
        term = aggregate(agg, F.col("_value"), value.kind, self.compat).alias(title(agg, name))
        mine = self.catalog.frame_for(left, value).select(F.col(f"`{left.name}`").alias("_key"), F.col(f"`{name}`").alias("_value"))
        if not query.group:
            other = self.catalog.frame_for(right).select(F.col(f"`{right.name}`").alias("_other"))
            return mine.join(other, F.col("_key") == F.col("_other")).agg(term)
        group = self.catalog.column(query.group)
        other = self.catalog.frame_for(right, group).select(F.col(f"`{right.name}`").alias("_other"), F.col(f"`{group.name}`").alias(f"{group.name}"))
        grouped = mine.join(other, F.col("_key") == F.col("_other")).groupBy(f"`{group.name}`").agg(term)
        return self._after_groups(grouped, query, group.name)
