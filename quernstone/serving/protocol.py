"""Binary requests and responses, access rules, audit, and the dispatcher between bytes and the engine."""

from __future__ import annotations

import hmac
import struct
from dataclasses import dataclass, field
from enum import IntEnum

from ..engine import Engine
from ..model import Agg, Cmp, Kind, Predicate, Query, QueryError, Status


class Op(IntEnum):
    GET, PUT, QUERY, HEALTH, STATS = range(1, 6)


OK, BAD_REQUEST, FORBIDDEN, UNAUTHENTICATED = 0, 1000, 1001, 1002
# The request's fields in wire order, little-endian.
FIELDS = "kind key value value_col agg has_filter threshold cmp upper lo_i64 hi_i64 lo_f64 hi_f64 grouped key_col num_groups limit filter_col".split()
LAYOUT = struct.Struct("<IQQQIBIIIqqddBQIQQ")


@dataclass(frozen=True)
class Request:
    kind: int
    key: int = 0
    value: int = 0
    value_col: int = 0
    agg: int = 0
    has_filter: int = 0
    threshold: int = 0
    cmp: int = 0
    upper: int = 0
    lo_i64: int = 0
    hi_i64: int = 0
    lo_f64: float = 0.0
    hi_f64: float = 0.0
    grouped: int = 0
    key_col: int = 0
    num_groups: int = 0
    limit: int = 0
    filter_col: int = 0

    def encode(self) -> bytes:
        return LAYOUT.pack(*(getattr(self, f) for f in FIELDS))

    @staticmethod
    def decode(data: bytes) -> Request | None:
        """None unless the bytes are exactly one request with known codes."""
        if len(data) != LAYOUT.size:
            return None
        got = Request(*LAYOUT.unpack(data))
        sound = got.kind in Op.__members__.values() and got.cmp in Cmp.__members__.values() and got.agg <= Agg.MAX and got.has_filter <= 1 and got.grouped <= 1
        return got if sound else None


def encode_response(status: int, values: list[int | float] = ()) -> bytes:
    body = b"".join(struct.pack("<d", v) if isinstance(v, float) else struct.pack("<Q", v & (2**64 - 1)) for v in values)
    return struct.pack("<IQ", status, len(values)) + body


def decode_response(data: bytes) -> tuple[int, list[int]]:
    status, n = struct.unpack_from("<IQ", data)
    if len(data) != 12 + 8 * n:
        raise ValueError("a response of the wrong length")
    return status, list(struct.unpack_from(f"<{n}Q", data, 12))


@dataclass
class Policy:
    """What each principal may do. A principal without grants may do nothing but HEALTH and STATS."""

    columns: dict[str, set[int]] = field(default_factory=dict)
    readers: set[str] = field(default_factory=set)
    writers: set[str] = field(default_factory=set)
    tokens: dict[str, str] = field(default_factory=dict)

    def principal(self, token: str) -> str | None:
        found = None
        for known, name in self.tokens.items():
            if hmac.compare_digest(known.encode(), token.encode()):
                found = name
        return found

    def allows(self, who: str, request: Request) -> bool:
        if request.kind == Op.GET:
            return who in self.readers
        if request.kind == Op.PUT:
            return who in self.writers
        if request.kind == Op.QUERY:
            asked = {request.value_col} | ({request.key_col} if request.grouped else set()) | ({request.filter_col} if request.filter_col else set())
            return asked <= self.columns.get(who, set())
        return True


class Service:
    """Column numbers are the catalog's columns in order of first registration, from 1."""

    def __init__(self, engine: Engine, policy: Policy):
        self.engine, self.policy, self.audit = engine, policy, []

    def number(self, name: str) -> int:
        return list(self.engine.catalog.columns).index(name) + 1

    def _name(self, number: int) -> str:
        names = list(self.engine.catalog.columns)
        if not 1 <= number <= len(names):
            raise QueryError(Status.UNKNOWN_COLUMN, str(number))
        return names[number - 1]

    def _query(self, r: Request) -> list[int | float]:
        value, where = self._name(r.value_col), None
        if r.has_filter:
            name = self._name(r.filter_col) if r.filter_col else value
            kind = self.engine.catalog.column(name).kind
            bounds = {Kind.U32: (r.threshold, r.upper), Kind.I64: (r.lo_i64, r.hi_i64), Kind.F64: (r.lo_f64, r.hi_f64)}.get(kind)
            if bounds is None:
                raise QueryError(Status.UNSUPPORTED_TYPE, "string filters have no wire form")
            where = Predicate(name, Cmp(r.cmp), *bounds)
        group = self._name(r.key_col) if r.grouped else None
        if group and r.num_groups == 0:
            raise QueryError(Status.INVALID_GROUP, "no groups asked for")
        rows = self.engine.query(Query(((Agg(r.agg), value),), where=where, group=group, dense=bool(group))).collect()
        out = [row[-1] for row in rows]
        out = [0 if v is None else v for v in out]
        if group:
            out = (out + [0] * r.num_groups)[: r.num_groups]
        return out[: r.limit] if r.limit else out

    def serve(self, who: str, data: bytes) -> bytes:
        """One request to one response; every one is audited, malformed ones too."""
        request = Request.decode(data)
        status, values = OK, []
        if request is None:
            status = BAD_REQUEST
        elif not self.policy.allows(who, request):
            status = FORBIDDEN
        else:
            try:
                with self.engine.catalog.lock if request.kind == Op.PUT else self.engine.latency.timed():
                    values = self._run(request)
            except QueryError as wrong:
                status = int(wrong.status)
        self.audit.append((who, request.kind if request else 0, status))
        return encode_response(status, values)

    def _run(self, request: Request) -> list[int | float]:
        if request.kind == Op.QUERY:
            return self._query(request)
        if request.kind == Op.HEALTH:
            return list(self.engine.health().values())
        if request.kind == Op.STATS:
            return list(self.engine.stats().values())
        if self.engine.store is None:
            raise QueryError(Status.UNSUPPORTED_TYPE, "no store is open")
        if request.kind == Op.GET:
            found = self.engine.store.get(request.key)
            return [] if found is None else [found]
        self.engine.store.put(request.key, request.value)
        return []

    def serve_with_token(self, token: str, data: bytes) -> bytes:
        who = self.policy.principal(token)
        if who is None:
            self.audit.append(("", 0, UNAUTHENTICATED))
            return encode_response(UNAUTHENTICATED)
        return self.serve(who, data)
