"""Hand-worked vectors and small differentials for the core engine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.engine import Engine
from quernstone.model import Agg, Cmp, Kind, Predicate, Query, QueryError, Status
from quernstone.operators import groups, joins, keyvalue as kv
from quernstone.plans.grammar import parse

NAN = float("nan")


def drawn(seed, n):
    """A log of room bookings: minutes (some null), topic, room with gaps and ties; drawn, so that answers are counted."""
    rng = random.Random(seed)
    topics = ["æther", "brick", "cinder", "dye"]
    return [(None if rng.random() < 0.15 else rng.randrange(1, 400) * 3, rng.choice(topics), rng.choice([2, 3, 3, 7, 11])) for _ in range(n)]


BOOKED = drawn(29, 57)
ROOMS = [(2, "attic"), (3, "barn"), (7, "attic"), (5, "unused"), (11, "cellar")]


@pytest.fixture
def shop(spark):
    e = Engine(spark)
    minutes, topics, rooms = zip(*BOOKED, strict=True)
    e.load_rows("booked", {"minutes": ("u32", [m or 0 for m in minutes]), "topic": ("str", list(topics)), "room": ("u32", list(rooms))}, {"minutes": [int(m is None) for m in minutes]})
    e.load_rows("rooms", {"room_key": ("u32", [k for k, _ in ROOMS]), "room_name": ("str", [n for _, n in ROOMS])})
    return e


def summed(pairs):
    out = {}
    for k, v in pairs:
        out[k] = out.get(k, 0) + (v or 0)
    return sorted(out.items())


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_scalars_groups_and_distinct(shop):
    known = [m for m, _, _ in BOOKED if m is not None]
    by_topic = summed((t, m) for m, t, _ in BOOKED)
    assert rows(shop.sql("SELECT SUM(minutes)")) == [(sum(known),)]
    assert rows(shop.sql("select avg(minutes)")) == [(pytest.approx(sum(known) / len(known)),)]
    assert rows(shop.sql("SELECT COUNT(DISTINCT topic)")) == [(len({t for _, t, _ in BOOKED}),)]
    assert rows(shop.sql("SELECT COUNT(DISTINCT minutes)")) == [(len(set(known)),)]
    assert rows(shop.sql("SELECT SUM(minutes) GROUP BY topic")) == by_topic
    some = {t: [m for m, u, _ in BOOKED if u == t and m is not None and m > 500] for t, _ in by_topic}
    assert rows(shop.sql("SELECT COUNT(minutes), SUM(minutes), MAX(minutes) WHERE minutes > 500 GROUP BY topic")) == [(t, len(v), sum(v), max(v)) for t, v in sorted(some.items()) if v]
    assert rows(shop.sql("SELECT SUM(minutes) WHERE topic = 'brick'")) == [(dict(by_topic)["brick"],)]
    means = {t: sum(v) / len(v) for t, _ in by_topic if (v := [m for m, u, _ in BOOKED if u == t and m is not None])}
    best = max(means, key=means.get)
    assert rows(shop.sql("SELECT AVG(minutes) GROUP BY topic ORDER BY AVG DESC LIMIT 1")) == [(best, pytest.approx(means[best]))]


def test_joins(shop):
    join = "JOIN room = room_key"
    met = [(m, t, name) for m, t, room in BOOKED for key, name in ROOMS if key == room]
    by_name = summed((name, m) for m, _, name in met)
    assert rows(shop.sql(f"SELECT COUNT(*) {join}")) == [(len(met),)]
    assert rows(shop.sql(f"SELECT SUM(minutes) {join}")) == [(sum(m or 0 for m, _, _ in met),)]
    assert rows(shop.sql(f"SELECT SUM(minutes) {join} GROUP BY room_name")) == by_name
    bar = sorted(v for _, v in by_name)[1]
    assert rows(shop.sql(f"SELECT SUM(minutes) {join} GROUP BY room_name HAVING SUM >= {bar}")) == [x for x in by_name if x[1] >= bar]
    assert rows(shop.sql(f"SELECT SUM(minutes) {join} GROUP BY room_name ORDER BY SUM DESC LIMIT 1")) == [max(by_name, key=lambda x: x[1])]
    shown = rows(shop.sql(f"SELECT minutes, room_name {join} LIMIT 100"))
    assert sorted(shown, key=str) == sorted(((m, name) for m, _, name in met), key=str)
    for text in ("SELECT SUM(minutes) JOIN topic = room_name", "SELECT COUNT(*) JOIN minutes = room_name"):
        with pytest.raises(QueryError) as e:
            shop.sql(text)
        assert e.value.status is Status.UNSUPPORTED_TYPE


def test_join_pairs_of_long_keys(spark):
    rng = random.Random(31)
    keys = [-(2**40), -3, 0, 1, 2**33 + 1, 2**62, 17, 18, 19]
    left, right = [rng.choice(keys[:7]) for _ in range(45)], [rng.choice(keys[2:]) for _ in range(33)]
    e = Engine(spark)
    e.load_rows("l", {"lk": ("i64", left)})
    e.load_rows("r", {"rk": ("i64", right)})
    want = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x == y]
    found = joins.join_pairs(e.catalog.numbered("l"), "lk", e.catalog.numbered("r"), "rk")
    assert sorted(rows(found)) == want
    assert rows(e.sql("SELECT COUNT(*) JOIN lk = rk")) == [(len(want),)]


def test_having_top_and_dense(spark):
    e = Engine(spark)
    rng = random.Random(37)
    pairs = [(rng.choice([0, 1, 4, 9]), rng.randrange(500)) for _ in range(41)]
    e.load_rows("t", {"shelf": ("u32", [k for k, _ in pairs]), "weight": ("u32", [v for _, v in pairs])})
    sums = summed(pairs)
    ranked = sorted(sums, key=lambda x: (-x[1], x[0]))
    assert rows(e.sql("SELECT SUM(weight) GROUP BY shelf ORDER BY SUM DESC LIMIT 2")) == ranked[:2]
    assert rows(e.sql(f"SELECT SUM(weight) GROUP BY shelf HAVING SUM > {ranked[2][1]}")) == sorted(ranked[:2])
    assert rows(e.sql(f"SELECT SUM(weight) GROUP BY shelf HAVING weight BETWEEN {ranked[2][1]} AND {ranked[1][1]}")) == sorted(ranked[1:3])
    e.load_rows("g", {"k": ("u32", [0, 4]), "v": ("u32", [1, 2])})
    assert rows(e.query(Query(((Agg.COUNT, "v"), (Agg.MIN, "v")), group="k", dense=True)).orderBy("k")) == [(0, 1, 1), (1, 0, None), (2, 0, None), (3, 0, None), (4, 1, 2)]
    capped = Engine(spark, group_cap=3)
    capped.load_rows("g", {"k": ("u32", [0, 4]), "v": ("u32", [1, 2])})
    with pytest.raises(QueryError) as too_many:
        capped.sql("SELECT SUM(v) GROUP BY k")
    assert too_many.value.status is Status.TOO_MANY_GROUPS
    assert rows(groups.top_groups(e.catalog.frames["t"], "shelf", "weight", 1).select("weight")) == [(max(v for _, v in pairs),)]


def test_nulls_and_sentinels(spark):
    e = Engine(spark)
    e.load_rows("t", {"u": ("u32", [17, 4, 4, 91, 8, 33, 0]), "d": ("f64", [0.25, NAN, -7.5, 6.0, NAN, 2.0, 2.0])}, {"u": [1, 0, 0, 0, 1, 0, 1], "d": [0, 0, 0, 1, 0, 0, 0]})
    assert rows(e.sql("SELECT COUNT(u), SUM(u), MIN(u), MAX(u)")) == [(4, 132, 4, 91)]
    assert rows(e.sql("SELECT MIN(d), MAX(d)")) == [(-7.5, 2.0)]
    assert rows(e.sql("SELECT COUNT(d) WHERE d > -100")) == [(4,)]
    assert rows(e.sql("SELECT COUNT(d) WHERE d != 2")) == [(4,)]
    assert rows(e.sql("SELECT COUNT(d) WHERE d != nan")) == [(6,)] and rows(e.sql("SELECT COUNT(d) WHERE d = nan")) == [(0,)]
    assert rows(e.sql("SELECT COUNT(DISTINCT d)")) in ([(4,)], [(5,)])
    assert rows(e.sql("SELECT SUM(u), MIN(u), AVG(u) WHERE u > 1000")) == [(0, None, None)]
    compat = Engine(spark, compat=True)
    compat.load_rows("t", {"u": ("u32", [1]), "i": ("i64", [1]), "f": ("f64", [1.0])})
    (low, high, avg), = rows(compat.sql("SELECT MIN(u), MAX(u), AVG(u) WHERE u > 5"))
    assert (int(low), int(high)) == (2**64 - 1, 0) and math.isnan(avg)
    assert rows(compat.sql("SELECT MIN(i), MAX(i) WHERE i > 5")) == [(2**63 - 1, -(2**63))]
    assert rows(compat.sql("SELECT MIN(f), MAX(f) WHERE f > 5")) == [(math.inf, -math.inf)]


def test_overflow_raises(spark):
    e = Engine(spark)
    e.load_rows("t", {"i": ("i64", [2**63 - 1, 1])})
    with pytest.raises(Exception, match="OVERFLOW"):
        e.sql("SELECT SUM(i)").collect()


def test_row_order_operators(spark):
    e = Engine(spark)
    e.load_rows("t", {"v": ("u32", [10, 20, 30, 40]), "s": ("str", list("abab"))})
    assert rows(e.sql("SELECT v WHERE s = b")) == [(20,), (40,)]
    assert rows(e.sql("SELECT v LIMIT 2")) == [(10,), (20,)] and rows(e.sql("SELECT v LIMIT 0")) == []
    frame = e.catalog.numbered("t")
    assert rows(joins.matching_rows(frame, F.col("v") > 10, 2)) == [(1,), (2,)]
    wanted = spark.createDataFrame([(0, 3), (1, 0), (2, 3)], "place int, row long")
    assert rows(joins.gather(frame, "v", wanted)) == [(0, 40), (1, 10), (2, 40)]
    with pytest.raises(Exception, match="no such row"):
        joins.gather(frame, "v", spark.createDataFrame([(0, 9)], "place int, row long")).collect()


def test_columns_of_two_datasets_align_by_row(spark):
    e = Engine(spark)
    e.load_rows("a", {"x": ("u32", [1, 2, 3])})
    e.load_rows("b", {"y": ("str", ["p", "q", "p"])})
    e.load_rows("c", {"z": ("u32", [1])})
    assert rows(e.sql("SELECT SUM(x) WHERE y = p")) == [(4,)]
    assert rows(e.sql("SELECT SUM(x) GROUP BY y")) == [("p", 4), ("q", 2)]
    with pytest.raises(QueryError) as e1:
        e.sql("SELECT SUM(x) WHERE z = 1")
    assert e1.value.status is Status.INVALID_GROUP
    assert e.catalog.table("t", ["x", "y"]).count() == 3


def test_append_keeps_order_and_types(spark):
    e = Engine(spark)
    e.load_rows("t", {"v": ("u32", [1, 2])}, {"v": [0, 1]})
    e.append("t", {"v": [7, 8]})
    assert rows(e.sql("SELECT v")) == [(1,), (None,), (7,), (8,)] and rows(e.sql("SELECT SUM(v)")) == [(16,)]
    with pytest.raises(QueryError):
        e.append("t", {"w": [1]})


@pytest.mark.parametrize(("text", "status"), [
    ("", Status.PARSE), ("SELECT", Status.PARSE), ("SELECT SUM minutes", Status.PARSE), ("SELECT SUM(minutes", Status.PARSE), ("SELECT SUM(minutes) junk", Status.PARSE),
    ("SELECT COUNT(*)", Status.PARSE), ("SELECT SUM(minutes) WHERE minutes == 3", Status.PARSE), ("SELECT SUM(minutes) WHERE minutes >", Status.PARSE),
    ("SELECT SUM(minutes) WHERE minutes > -5", Status.PARSE), ("SELECT SUM(minutes) WHERE minutes > 4294967296", Status.PARSE), ("SELECT SUM(minutes) WHERE minutes BETWEEN 1", Status.PARSE),
    ("SELECT SUM(nope)", Status.UNKNOWN_COLUMN), ("SELECT SUM(minutes) WHERE nope > 1", Status.UNKNOWN_COLUMN), ("SELECT SUM(minutes) GROUP BY nope", Status.UNKNOWN_COLUMN),
    ("SELECT SUM(topic)", Status.UNSUPPORTED_TYPE), ("SELECT SUM(minutes) GROUP BY minutes", Status.INVALID_GROUP), ("SELECT SUM(minutes) ORDER BY SUM DESC LIMIT 1", Status.PARSE),
    ("SELECT SUM(minutes) GROUP BY room ORDER BY SUM ASC LIMIT 1", Status.PARSE), ("SELECT SUM(minutes) GROUP BY room ORDER BY SUM DESC LIMIT 0", Status.PARSE),
    ("SELECT SUM(minutes) GROUP BY room HAVING COUNT > 1", Status.PARSE), ("SELECT minutes, room", Status.PARSE), ("SELECT COUNT(DISTINCT minutes) GROUP BY room", Status.PARSE),
    ("SELECT AVG(minutes) JOIN room = room_key", Status.PARSE), ("SELECT minutes JOIN room = room_key", Status.PARSE), ("SELECT SUM(minutes) JOIN room room_key", Status.PARSE),
])
def test_malformed_queries(shop, text, status):
    with pytest.raises(QueryError) as e:
        shop.sql(text)
    assert e.value.status is status


def test_parser_takes_literals_and_case():
    q = parse("select Count(x) where s between 'a b' and \"c\" group by k having count >= 2")
    assert q.where == Predicate("s", Cmp.BETWEEN, "a b", "c") and q.having == Predicate("count", Cmp.GE, "2") and q.group == "k"


def test_key_value_operators(spark):
    log = spark.createDataFrame([(0, "WRITE", 1, 10), (1, "TXN", 1, 11), (2, "TXN", 2, 20), (3, "COMMIT", None, None), (4, "WRITE", 2, 21), (5, "TXN", 3, 30)], "seq long, op string, key long, value long")
    assert sorted(rows(kv.replay(log))) == [(1, 11), (2, 21)]
    far = spark.createDataFrame([(0, "TXN", 1, 5), (200_000, "COMMIT", None, None), (200_001, "TXN", 1, 6)], log.schema)
    assert rows(kv.replay(far)) == [(1, 5)]
    state = kv.latest(log.where("op <> 'COMMIT'"))
    assert sorted(rows(kv.get(state, spark.createDataFrame([(1,), (9,)], "key long")))) == [(1, 11), (9, 0)]
    assert rows(kv.key_range(state, 2, 3, ordered=True)) == [(2, 21), (3, 30)]
    by_txn = spark.createDataFrame([(0, "TXN", 7, 1, 5), (1, "TXN", 8, 2, 6), (2, "COMMIT", 8, None, None)], "seq long, op string, txn long, key long, value long")
    assert rows(kv.replay_by_transaction(by_txn)) == [(2, 6)]
    assert rows(spark.range(1).select(kv.page_of(F.lit(65536 + 130)))) == [(2,)]
    paged = kv.by_page(log.where("key IS NOT NULL"), 2)
    assert paged.count() == 5


def test_dictionary_codes(spark):
    codes = joins.encode_dictionary(spark.createDataFrame([("b",), ("a",), ("b",), ("é",), (None,)], "s string"), "s")
    assert sorted(rows(codes)) == [("a", 0), ("b", 1), ("é", 2)]


def test_kinds_of_parquet_columns(spark, tmp_path):
    spark.sql("SELECT 1 AS i, 2.5D AS d, 'x' AS s, TIMESTAMP '1970-01-01 00:00:01' AS t, array(1) AS a").write.parquet(f"{tmp_path}/t")
    e = Engine(spark)
    e.load_parquet(f"{tmp_path}/t", "t", {"i": Kind.U32})
    assert {c.name: c.kind.value for c in e.catalog.columns.values()} == {"i": "u32", "d": "f64", "s": "str", "t": "i64"}
    assert rows(e.sql("SELECT MAX(t)")) == [(1_000_000,)]


def test_dictionary_of_absent_values_and_fingerprint(spark):
    codes = joins.encode_dictionary(spark.createDataFrame([("pear",), ("fig",), (None,), ("fig",)], "s string"), "s")
    asked = spark.createDataFrame([(1, "fig"), (2, "kiwi"), (3, None), (4, "pear")], "n int, s string")
    assert sorted(rows(joins.encode_values(asked, "s", codes).select("n", "code"))) == [(1, 0), (2, 2), (3, 2), (4, 1)]
    wanted = spark.createDataFrame([(1, 1), (2, 2), (3, -1), (4, None)], "n int, code long")
    assert sorted(rows(joins.decode_values(wanted, codes).select("n", "value"))) == [(1, "pear"), (2, ""), (3, ""), (4, "")]
    values = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    once = rows(kv.fingerprint(values, "v"))
    assert rows(kv.fingerprint(values.orderBy("v").repartition(3), "v")) == once
    assert rows(kv.fingerprint(values.distinct(), "v")) != once and rows(kv.fingerprint(values.where("v > 'x'"), "v")) == [("0",)]
