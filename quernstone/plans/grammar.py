"""Query text to Query. No Spark, no catalog: names and literals stay text."""

from __future__ import annotations

import re

from ..model import SYMBOLS, Agg, Cmp, Predicate, Query, QueryError, Status

_TOKEN = re.compile(r"""\s*(?:('[^']*'|"[^"]*")|([()*,])|([<>=!]+)|([^\s()<>=!,]+))""")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise QueryError(Status.PARSE, text[at:])
        out.append(found[0].strip())
        at = found.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at].upper() if self.at < len(self.tokens) else ""

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise QueryError(Status.PARSE, "the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, *words: str) -> None:
        for word in words:
            if (got := self.take()).upper() != word:
                raise QueryError(Status.PARSE, f"{word} expected, not {got}")

    def accept(self, *words: str) -> bool:
        if self.peek() != words[0]:
            return False
        self.expect(*words)
        return True

    def name(self) -> str:
        got = self.take()
        if not re.fullmatch(r"[^\s()<>=!,*'\"]+", got):
            raise QueryError(Status.PARSE, f"a name expected, not {got}")
        return got

    def value(self) -> str:
        got = self.take()
        if got[0] in "()*,<>=!":
            raise QueryError(Status.PARSE, f"a value expected, not {got}")
        return got[1:-1] if len(got) >= 2 and got[0] in "'\"" and got[-1] == got[0] else got

    def number(self) -> int:
        got = self.take()
        if not re.fullmatch(r"[0-9]+", got):
            raise QueryError(Status.PARSE, f"a number expected, not {got}")
        return int(got)

    def predicate(self) -> Predicate:
        column = self.name()
        if self.accept("BETWEEN"):
            low = self.value()
            self.expect("AND")
            return Predicate(column, Cmp.BETWEEN, low, self.value())
        symbol = self.take()
        if symbol not in SYMBOLS:
            raise QueryError(Status.PARSE, f"{symbol} is no comparison")
        return Predicate(column, SYMBOLS[symbol], self.value())


def parse(text: str) -> Query:
    """SELECT list [JOIN a = b] [WHERE p] [GROUP BY k] [HAVING h] [ORDER BY x DESC LIMIT n] [LIMIT n].

    One predicate at most in WHERE and HAVING. Without aggregates: one column, or two with JOIN. A join takes no WHERE
    and one aggregate. COUNT(DISTINCT c) stands alone. Keywords may have any case.
    """
    read = _Reader(text)
    read.expect("SELECT")
    aggs, plain, distinct = [], [], None
    while True:
        if read.peek() in Agg.__members__ and read.at + 1 < len(read.tokens) and read.tokens[read.at + 1] == "(":
            agg = Agg[read.take().upper()]
            read.expect("(")
            if agg is Agg.COUNT and read.accept("DISTINCT"):
                distinct = read.name()
            elif agg is Agg.COUNT and read.accept("*"):
                aggs.append((agg, None))
            else:
                aggs.append((agg, read.name()))
            read.expect(")")
        else:
            plain.append(read.name())
        if not read.accept(","):
            break
    wrong = QueryError(Status.PARSE, text)
    if (distinct and (aggs or plain or read.peek())) or (aggs and plain):
        raise wrong
    join = where = group = having = order = limit = None
    if read.accept("JOIN"):
        join = (read.name(), (read.expect("="), read.name())[1])
    elif read.accept("WHERE"):
        where = read.predicate()
    if aggs and read.accept("GROUP", "BY"):
        group = read.name()
    if group and read.accept("HAVING"):
        having = read.predicate()
    if group and read.accept("ORDER", "BY"):
        order = read.name()
        read.expect("DESC", "LIMIT")
        limit = read.number()
        if limit == 0 and not join:
            raise wrong
    elif plain and read.accept("LIMIT"):
        limit = read.number()
    if read.peek():
        raise wrong
    starred = any(c is None for _, c in aggs)
    if plain and len(plain) != (2 if join else 1):
        raise wrong
    if join and aggs and (len(aggs) > 1 or aggs[0][0] is Agg.AVG or (starred and group)):
        raise wrong
    if starred and not join:
        raise wrong
    if not join:
        for name in (having and having.column, order):
            if name and name.upper() not in {a.name for a, _ in aggs} and name not in {c for _, c in aggs}:
                raise wrong
    return Query(tuple(aggs), tuple(plain), distinct, where, group, having, order, limit, join)
