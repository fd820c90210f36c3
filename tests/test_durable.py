"""Files, snapshots, the log store, streaming, tiering, serving and the shell."""

import io
import random
import socket
import struct

import pytest

from quernstone import metrics
from quernstone.cli import Shell
from quernstone.engine import Engine
from quernstone.model import Agg, Cmp, Kind, QueryError, Status
from quernstone.plans.grammar import parse
from quernstone.serving import protocol as P
from quernstone.serving.tcp import Client, Server
from quernstone.sources.store import Store
from quernstone.sources.text import read_columns
from quernstone.streaming import pipeline as S
from quernstone.tiering import COLD, HOST, Tiering, cheaper_tier, move_micros


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_strict_text(spark, tmp_path):
    good = put(tmp_path / "g.csv", "k,v\r\n1,10\r\n2,20\r\n3,30")
    e = Engine(spark)
    e.load_csv(good, {"k": (0, "u32"), "v": (1, "i64")}, header=True)
    assert rows(e.sql("SELECT v WHERE k >= 2")) == [(20,), (30,)]
    semi = put(tmp_path / "s.csv", "a;-7;1.5\nb;5000000000;-3.25e2;extra\n")
    frame = read_columns(spark, semi, {"s": (0, Kind.STR), "i": (1, Kind.I64), "f": (2, Kind.F64)}, delimiter=";")
    assert sorted(rows(frame)) == [(0, "a", -7, 1.5), (1, "b", 5_000_000_000, -325.0)]
    bad = {"short": "1,2\n3\n", "word": "1,x\n", "junk": "1,12x\n", "over": "1,5000000000\n", "blank": "1,2\n\n3,4\n", "space": "1, 2\n", "plus": "1,+2\n", "empty": "1,\n", "minus": "1,-1\n"}
    for name, text in bad.items():
        with pytest.raises(QueryError):
            read_columns(spark, put(tmp_path / f"{name}.csv", text), {"k": (0, Kind.U32), "v": (1, Kind.U32)})
    for text in ("1,1e999\n", "1,\n", "1,abc\n"):
        with pytest.raises(QueryError):
            read_columns(spark, put(tmp_path / "f.csv", text), {"v": (1, Kind.F64)})


def test_snapshot_and_backup(spark, tmp_path):
    e = Engine(spark, store=f"{tmp_path}/kv")
    e.load_rows("t", {"v": ("u32", [1, 2, 3]), "s": ("str", ["x", "y", "x"])}, {"v": [0, 1, 0]})
    e.catalog.table("both", ["v", "s"])
    e.store.put(5, 50)
    assert e.backup(f"{tmp_path}/b") and e.save(f"{tmp_path}/snap") and e.save(f"{tmp_path}/snap")
    fresh = Engine(spark, store=f"{tmp_path}/kv2")
    assert fresh.restore(f"{tmp_path}/b") and fresh.store.get(5) == 50
    assert rows(fresh.sql("SELECT SUM(v) GROUP BY s")) == [("x", 4), ("y", 0)] and fresh.catalog.tables["both"] == ("v", "s")
    assert rows(fresh.sql("SELECT s")) == [("x",), ("y",), ("x",)]
    assert not Engine(spark).load(f"{tmp_path}/nothing")
    (tmp_path / "broken").mkdir()
    put(tmp_path / "broken" / "_catalog.json", "{")
    assert not Engine(spark).load(f"{tmp_path}/broken")


def test_store_transactions_and_recovery(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/kv", capacity=3)
    assert s.put(1, 10) and s.put(1, 11)
    s.begin()
    s.txn_put(2, 20)
    with pytest.raises(RuntimeError):
        s.begin()
    s.rollback()
    s.begin()
    s.txn_put(3, 30)
    s.txn_put(1, 12)
    s.commit()
    assert sorted(rows(Store(spark, f"{tmp_path}/kv").state())) == [(1, 12), (3, 30)]
    # an append that no manifest names is not there
    spark.createDataFrame([(99, "WRITE", None, 8, 80)], "seq long, op string, txn long, key long, value long").write.parquet(f"{tmp_path}/kv/log-000000000099")
    assert Store(spark, f"{tmp_path}/kv").get(8) is None
    s.checkpoint()
    assert s.put(4, 40) and not s.put(5, 50) and s.dropped == 1
    s.close()
    again = Store(spark, f"{tmp_path}/kv")
    assert rows(again.range(1, 3)) == [(1, 12), (3, 30)] and again.get(4) == 40


def test_store_bulk_writes_durability_and_paths(spark, tmp_path):
    place = f"file://{tmp_path}/kv"
    s = Store(spark, place, capacity=5)
    came = [(0, 7, 70), (1, 8, 80), (2, 7, 71), (3, None, 5), (4, 9, None), (5, 1, 10)]
    assert s.write(spark.createDataFrame(came, "seq long, key long, value long")) == 0
    more = spark.createDataFrame([(0, 4, 40), (1, 3, 30), (2, 2, 20), (3, 8, 81)], "seq long, key long, value long")
    assert s.write(more) == 2 and s.dropped == 2  # one place is left, the first new key gets it
    want = [(1, 10), (4, 40), (7, 71), (8, 81), (9, None)]
    assert sorted(rows(Store(spark, place).state())) == want
    assert s.write(spark.createDataFrame([], "seq long, key long, value long")) == 0
    s.checkpoint()
    s.checkpoint()
    s.close()
    lazy = Store(spark, place, durability="off")
    assert sorted(rows(lazy.state())) == want and lazy.put(7, 72) and lazy.put(6, 60) and lazy.get(7) == 72
    assert Store(spark, place).get(7) == 71  # a crash would lose what the driver holds
    lazy.flush()
    assert Store(spark, place).get(7) == 72 and Store(spark, place).get(6) == 60
    assert lazy.put(7, 73)
    lazy.close()
    assert Store(spark, place).get(7) == 73
    with pytest.raises(ValueError):
        Store(spark, place, durability="sometimes")


def test_restore_refuses_and_columns_have_files(spark, tmp_path):
    e = Engine(spark, store=f"{tmp_path}/kv")
    e.load_rows("t", {"v": ("u32", [4, 5, 6]), "s": ("str", ["p", "q", "p"])}, {"v": [0, 1, 0]})
    for k in range(4):
        e.store.put(k, k)
    assert e.backup(f"file://{tmp_path}/b")
    small = Engine(spark, store=f"{tmp_path}/small")
    small.store.capacity = 3
    assert not small.restore(f"file://{tmp_path}/b") and not small.catalog.columns and small.store.state().count() == 0
    small.store.capacity = 4
    assert small.restore(f"file://{tmp_path}/b") and sorted(rows(small.store.state())) == [(k, k) for k in range(4)]
    assert rows(small.sql("SELECT COUNT(v), SUM(v)")) == [(2, 10)]
    e.save_column("s", f"{tmp_path}/s")
    fresh = Engine(spark)
    assert fresh.load_column(f"{tmp_path}/s", "named") == "named"
    assert rows(fresh.sql("SELECT named WHERE named = 'p'")) == [("p",), ("p",)]
    with pytest.raises(FileNotFoundError):
        fresh.load_column(f"{tmp_path}/none")


def test_snapshot_replaced_from_itself(spark, tmp_path):
    place = f"file://{tmp_path}/snap"
    e = Engine(spark)
    e.load_rows("t", {"v": ("i64", [-1, 2])})
    assert e.save(place)
    again = Engine(spark)
    assert again.load(place) and again.save(place)
    assert rows(again.sql("SELECT SUM(v)")) == [(1,)]
    third = Engine(spark)
    assert third.load(place) and rows(third.sql("SELECT MIN(v)")) == [(-1,)]
    kept = [p.name for p in (tmp_path / "snap").iterdir() if not p.name.startswith((".", "_"))]
    assert sorted(n.split("-")[0] for n in kept) == ["catalog", "v", "v"]


def test_states_of_a_stream_by_scheme(spark, tmp_path):
    pipe = S.Pipeline(spark, f"file://{tmp_path}/out", keep=2)
    for n in range(4):
        pipe.apply(spark.createDataFrame([(n, S.WRITE, 1, n), (n, S.WRITE, 10 + n, n)], S.OPERATIONS), n)
    assert sorted(rows(pipe.final_state())) == [(1, 3), (10, 0), (11, 1), (12, 2), (13, 3)]
    assert pipe.state(3).count() == 4
    for gone in (1, 9):
        with pytest.raises(FileNotFoundError):
            pipe.state(gone)


def test_stream_counts_and_state(spark, tmp_path):
    rng = random.Random(3)
    ops = [(i, rng.choice([S.READ, S.WRITE, S.SCAN, S.TXN_WRITE]), rng.randint(0, 40), i * 10) for i in range(600)]
    frame = spark.createDataFrame(ops, S.OPERATIONS)
    for k in range(3):
        frame.where(f"seq div 200 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    pipe = S.Pipeline(spark, f"{tmp_path}/out", spark.range(100).withColumnRenamed("id", "v"), 49)
    pipe.start(f"{tmp_path}/in").awaitTermination()
    assert sorted(rows(pipe.final_state())) == sorted(rows(S.state_after(frame)))
    totals = {r.opcode: r for r in pipe.totals().collect()}
    assert sum(r.n for r in totals.values()) == 600 and totals[S.SCAN].scanned == 50 * totals[S.SCAN].n
    before = sorted(rows(pipe.state(2)))
    pipe.apply(frame.where("seq div 200 = 1"), 1)  # a batch that runs again
    assert sorted(rows(pipe.state(2))) == before
    assert S.batches(frame).where("batch_id = 1").count() == 88
    aged = spark.createDataFrame([(0, 1), (49, 1), (50, 1), (120, 1)], "at long, lane int")
    assert sorted(r.batch_id for r in S.batches_by_age(aged, "at", "lane").collect()) == [0, 0, 1, 2]


def test_batches_end_by_size_or_age(spark):
    rows_in = [(0, 1, 1), (60, 1, 2), (105, 1, 3), *((200, 2, k) for k in range(5)), (249, 2, 5), (250, 2, 6), (None, 2, 7), (7, None, 8)]
    frame = spark.createDataFrame(rows_in, "at long, lane int, seq long").repartition(3)
    got = {r.seq if r.lane != 2 else (2, r.seq): r.batch_id for r in S.batches_by_age(frame, "at", "lane", rows=4, seq="seq").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 8: 0, **{(2, k): 0 for k in range(4)}, (2, 4): 1, (2, 5): 1, (2, 6): 2, (2, 7): None}


def test_tiers():
    t = Tiering(budget=2_000_000)
    for name, tier in (("a", HOST), ("b", HOST), ("c", COLD)):
        t.add(name, 1_000_000, tier)
    t.items["a"].recent = 1000
    t.rebalance()
    assert t.items["a"].heat == 500
    t.rebalance()
    assert t.items["a"].heat == 250
    for _ in range(40):
        t.scanned("c")
    assert t.items["c"].tier == HOST and t.used() <= t.budget and t.borrows > 0 and t.migrations >= 2
    t.add("d", 3_000_000)
    for _ in range(4):
        t.rebalance()
    assert t.used() <= t.budget
    assert cheaper_tier(1 << 30) == "DEVICE" and cheaper_tier(1000) == HOST and move_micros(10, HOST, HOST) == 0


def test_latency_and_version():
    lat = metrics.Latency()
    for n in [10] * 98 + [10_000] * 2:
        lat.record(n)
    assert lat.percentile(0.5) < 16 and lat.percentile(0.99) > 8000 and lat.largest == 10_000 and metrics.Latency().percentile(0.5) == 0
    assert metrics.packed_version() == 1 << 16


@pytest.fixture
def service(spark, tmp_path):
    e = Engine(spark, store=f"{tmp_path}/kv")
    e.load_rows("t", {"k": ("u32", [0, 1, 0, 2]), "v": ("i64", [-5, 7, 9, 11]), "f": ("f64", [0.5, 1.5, 2.5, 3.5])})
    return P.Service(e, P.Policy({"ann": {1, 2}, "bob": {1, 2, 3}}, {"ann"}, {"bob"}, {"secret": "bob"}))


def ask(service, who, **fields):
    return P.decode_response(service.serve(who, P.Request(**fields).encode()))


def test_requests(service):
    q = {"kind": P.Op.QUERY, "value_col": 2, "agg": Agg.SUM}
    assert ask(service, "ann", **q) == (P.OK, [22])
    assert ask(service, "ann", **q, has_filter=1, cmp=Cmp.LT, lo_i64=0) == (P.OK, [2**64 - 5])
    assert ask(service, "ann", **q, grouped=1, key_col=1, num_groups=4) == (P.OK, [4, 7, 11, 0])
    assert ask(service, "ann", **q, grouped=1, key_col=1, num_groups=4, limit=2) == (P.OK, [4, 7])
    status, (bits,) = ask(service, "bob", kind=P.Op.QUERY, value_col=3, agg=Agg.MAX)
    assert (status, struct.unpack("<d", struct.pack("<Q", bits))) == (P.OK, (3.5,))
    assert ask(service, "ann", **q, has_filter=1, filter_col=3)[0] == P.FORBIDDEN
    assert ask(service, "eve", **q)[0] == ask(service, "ann", kind=P.Op.PUT)[0] == ask(service, "bob", kind=P.Op.GET)[0] == P.FORBIDDEN
    assert ask(service, "eve", kind=P.Op.HEALTH)[1][2] == 3 and len(ask(service, "eve", kind=P.Op.STATS)[1]) == len(metrics.STATS)
    assert ask(service, "bob", kind=P.Op.PUT, key=4, value=44) == (P.OK, []) and ask(service, "ann", kind=P.Op.GET, key=4) == (P.OK, [44]) and ask(service, "ann", kind=P.Op.GET, key=5) == (P.OK, [])
    assert ask(service, "bob", kind=P.Op.QUERY, value_col=9)[0] == P.FORBIDDEN
    assert P.decode_response(service.serve("ann", b"junk"))[0] == P.BAD_REQUEST and len(service.audit) == 16


def test_wire_rejects_and_round_trips():
    r = P.Request(*range(1, 6), 1, 7, 6, 9, -10, -11, 1.5, -2.5, 1, 12, 13, 14, 15)
    r = P.Request(**{**r.__dict__, "agg": 3})
    assert P.Request.decode(r.encode()) == r
    rng = random.Random(1)
    for _ in range(3000):
        data = bytearray(r.encode())
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        P.Request.decode(bytes(data[: rng.randint(0, len(data))] if rng.random() < 0.3 else data))
    for field, value in (("kind", 0), ("kind", 6), ("cmp", 7), ("agg", 4)):
        assert P.Request.decode(P.Request(**{**r.__dict__, field: value}).encode()) is None


def test_tcp(service):
    server = Server(service, tokens=True, timeout=2.0)
    port = server.start()
    client = Client(port, token="secret")
    assert client.ask(P.Request(P.Op.QUERY, value_col=2, agg=Agg.COUNT)) == (P.OK, [4])
    assert client.ask(P.Request(P.Op.HEALTH))[0] == P.OK
    wrong = Client(port, token="guess")
    assert wrong.ask(P.Request(P.Op.HEALTH))[0] == P.UNAUTHENTICATED
    huge = socket.create_connection(("127.0.0.1", port), 5)
    huge.sendall(struct.pack("<I", 1 << 29))
    assert huge.recv(10) == b""
    client.close()
    wrong.close()
    server.shutdown()
    server.server_close()


def test_parser_never_fails_otherwise():
    rng, words = random.Random(7), "SELECT COUNT SUM ( ) , * DISTINCT WHERE a b = != > BETWEEN AND GROUP BY HAVING ORDER DESC LIMIT 3 'x JOIN".split()
    for _ in range(5000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        try:
            parse(text)
        except QueryError as e:
            assert e.status is Status.PARSE


def test_shell(spark, tmp_path):
    put(tmp_path / "o.csv", "region,amount\n0,100\n1,250\n0,300\n")
    out = io.StringIO()
    Shell(Engine(spark), out).run(f"""# a comment
.load {tmp_path}/o.csv region u32 col0 header
.load {tmp_path}/o.csv amount u32 col1 header
SELECT SUM(amount)
SELECT SUM(amount) GROUP BY region
.mode csv
SELECT COUNT(amount), SUM(amount) GROUP BY region
SELECT SUM(nope)
.columns
.load {tmp_path}/o.csv bad u32 col0
.nonsense
.save {tmp_path}/db
.open {tmp_path}/db
.quit
SELECT SUM(amount)""".split("\n"))
    text = out.getvalue()
    assert "loaded amount: 3 rows\n650\n0 │ 400\n1 │ 250\n0,2,400\n1,1,250\nError: UNKNOWN_COLUMN: nope\n" in text
    assert "amount │ u32 │ 3" in text and "Error: UNSUPPORTED_TYPE" in text and "saved\nError: .open needs an empty session\n" in text and text.count("650") == 1
    again = io.StringIO()
    Shell(Engine(spark), again).run([f".open {tmp_path}/db", "SELECT MAX(amount)"])
    assert again.getvalue() == "opened\n300\n"
