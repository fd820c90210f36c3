"""Queries of the core engine by name, with their DuckDB equivalents."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import RID, numbered_file
from ..engine import Engine
from ..functions.expressions import aggregate, count_distinct, matches
from ..model import Agg, Cmp, Kind, Query
from ..operators import groups, joins, keyvalue as kv
from ..streaming import pipeline as stream

KEYS = {"l_linenumber": "u32", "o_custkey": "u32", "c_custkey": "u32", "l_suppkey": "u32", "s_suppkey": "u32", "c_nationkey": "u32", "s_nationkey": "u32"}
QUERIES: dict = {}
ORACLES: dict = {}


def _engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    engine = Engine(spark)
    for table in tables:
        engine.load_parquet(f"{sf_dir}/{table}.parquet", table, KEYS)
    return engine


def _text(name: str, tables: str, text: str, oracle: str) -> None:
    """A query in the engine's own language."""
    QUERIES[name] = lambda spark, sf_dir: _engine(spark, sf_dir, *tables.split()).sql(text)
    ORACLES[name] = oracle


def _frame(name: str, oracle: str | None = None):
    """A query through the DataFrame operators."""

    def add(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# scalar aggregates
for _agg in ("count", "sum", "min", "max"):
    _text(f"scalar_{_agg}", "lineitem", f"SELECT {_agg}(l_orderkey)", f"SELECT CAST({_agg}(l_orderkey) AS BIGINT) AS {_agg}_l_orderkey FROM lineitem")
_text("scalar_f64_minmax", "customer", "SELECT MIN(c_acctbal), MAX(c_acctbal)", "SELECT min(c_acctbal) AS min_c_acctbal, max(c_acctbal) AS max_c_acctbal FROM customer")
_text("multi_agg_scalar", "lineitem", "SELECT COUNT(l_orderkey), SUM(l_orderkey), MIN(l_orderkey), MAX(l_orderkey) WHERE l_linenumber <= 3",
      "SELECT count(l_orderkey) AS count_l_orderkey, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey FROM lineitem WHERE l_linenumber <= 3")
_text("sum_over_nothing", "lineitem", "SELECT SUM(l_orderkey), COUNT(l_orderkey), MIN(l_orderkey) WHERE l_linenumber > 4000",
      "SELECT CAST(coalesce(sum(l_orderkey), 0) AS BIGINT) AS sum_l_orderkey, count(l_orderkey) AS count_l_orderkey, min(l_orderkey) AS min_l_orderkey FROM lineitem WHERE l_linenumber > 4000")

# predicates
for _name, _op in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "!=")):
    _text(f"filter_{_name}", "lineitem", f"SELECT SUM(l_linenumber) WHERE l_linenumber {_op} 3", f"SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem WHERE l_linenumber {_op} 3")
_text("filter_between", "lineitem", "SELECT COUNT(l_orderkey) WHERE l_orderkey BETWEEN 100 AND 9000", "SELECT count(l_orderkey) AS count_l_orderkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 9000")
for _name, _text_where, _sql_where in (
    ("eq", "l_returnflag = 'R'", "l_returnflag = 'R'"),
    ("ne", "l_returnflag != 'R'", "l_returnflag <> 'R'"),
    ("absent", "l_returnflag = 'Q'", "l_returnflag = 'Q'"),
    ("absent_ne", "l_returnflag != 'Q'", "l_returnflag <> 'Q'"),
    ("range", "l_returnflag > 'F'", "l_returnflag > 'F'"),
    ("between", "l_returnflag BETWEEN 'B' AND 'P'", "l_returnflag BETWEEN 'B' AND 'P'"),
    ("below_first", "l_returnflag BETWEEN '0' AND '9'", "l_returnflag BETWEEN '0' AND '9'"),
):
    _text(f"filter_str_{_name}", "lineitem", f"SELECT COUNT(l_returnflag) WHERE {_text_where}", f"SELECT count(*) AS count_l_returnflag FROM lineitem WHERE {_sql_where}")
_text("cross_filter_u32", "lineitem", "SELECT SUM(l_orderkey) WHERE l_linenumber = 2", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey FROM lineitem WHERE l_linenumber = 2")
_text("cross_filter_str_i64", "orders", "SELECT SUM(o_custkey) WHERE o_orderstatus = 'F'", "SELECT CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey FROM orders WHERE o_orderstatus = 'F'")
_text("cross_filter_str_f64", "orders", "SELECT MIN(o_totalprice), MAX(o_totalprice) WHERE o_orderpriority >= '3'", "SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders WHERE o_orderpriority >= '3'")
_text("time_as_micros", "orders", "SELECT MIN(o_orderdate), MAX(o_orderdate)", "SELECT epoch_us(min(o_orderdate)) AS min_o_orderdate, epoch_us(max(o_orderdate)) AS max_o_orderdate FROM orders")

_NAN = "CASE WHEN c_custkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END"


@_frame("filter_f64_nan", f"SELECT count(*) FILTER (x > 100 AND NOT isnan(x)) AS gt, count(*) FILTER (x <= 100) AS le, count(*) FILTER (x <> 100) AS ne, count(*) FILTER (x BETWEEN 0 AND 500) AS mid, min(x) FILTER (NOT isnan(x)) AS low, max(x) FILTER (NOT isnan(x)) AS high, count(DISTINCT x) FILTER (NOT isnan(x)) + count(*) FILTER (isnan(x)) AS kinds FROM (SELECT {_NAN} AS x FROM customer)")
def _nan(spark, sf_dir):
    x = F.col("x")
    count = lambda cmp, low, high=None: F.count_if(matches(x, Kind.F64, cmp, low, high))
    frame = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("x"))
    return frame.agg(count(Cmp.GT, 100.0).alias("gt"), count(Cmp.LE, 100.0).alias("le"), count(Cmp.NE, 100.0).alias("ne"), count(Cmp.BETWEEN, 0.0, 500.0).alias("mid"), aggregate(Agg.MIN, x, Kind.F64).alias("low"), aggregate(Agg.MAX, x, Kind.F64).alias("high"), count_distinct(x, Kind.F64).alias("kinds"))


def _nullable(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_returnflag", F.nullif(F.col("l_linenumber"), F.lit(3)).cast("long").alias("v"))


_TERMS = [("n", Agg.COUNT), ("total", Agg.SUM), ("low", Agg.MIN), ("high", Agg.MAX)]
_NULLS = "SELECT {} count(v) AS n, CAST(coalesce(sum(v), 0) AS BIGINT) AS total, min(v) AS low, max(v) AS high FROM (SELECT l_returnflag, CAST(nullif(l_linenumber, 3) AS BIGINT) AS v FROM lineitem) {}"
_frame("null_aware_aggs", _NULLS.format("", ""))(lambda spark, sf_dir: _nullable(spark, sf_dir).agg(*[aggregate(a, F.col("v"), Kind.I64).alias(n) for n, a in _TERMS]))
_frame("null_aware_grouped", _NULLS.format("l_returnflag,", "GROUP BY l_returnflag"))(lambda spark, sf_dir: _nullable(spark, sf_dir).groupBy("l_returnflag").agg(*[aggregate(a, F.col("v"), Kind.I64).alias(n) for n, a in _TERMS]))


# averages and distinct counts
def _rounded(text: str, tables: str):
    def run(spark, sf_dir):
        frame = _engine(spark, sf_dir, *tables.split()).sql(text)
        return frame.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") else F.col(c) for c in frame.columns])

    return run


_frame("avg_scalar", "SELECT round(avg(l_orderkey), 6) AS avg_l_orderkey FROM lineitem")(_rounded("SELECT AVG(l_orderkey)", "lineitem"))
_frame("avg_filtered", "SELECT round(avg(l_orderkey), 6) AS avg_l_orderkey FROM lineitem WHERE l_linenumber >= 4")(_rounded("SELECT AVG(l_orderkey) WHERE l_linenumber >= 4", "lineitem"))
_frame("avg_grouped", "SELECT l_returnflag, round(avg(l_orderkey), 6) AS avg_l_orderkey FROM lineitem GROUP BY 1")(_rounded("SELECT AVG(l_orderkey) GROUP BY l_returnflag", "lineitem"))
for _kind, _table, _column in (("i64", "lineitem", "l_partkey"), ("u32", "lineitem", "l_suppkey"), ("f64", "part", "p_retailprice"), ("str", "events", "event_type")):
    _text(f"count_distinct_{_kind}", _table, f"SELECT COUNT(DISTINCT {_column})", f"SELECT count(DISTINCT {_column}) AS count_distinct_{_column} FROM {_table}")

# groups
for _agg in ("count", "sum", "min", "max"):
    _text(f"group_{_agg}_i64", "lineitem", f"SELECT {_agg}(l_orderkey) GROUP BY l_linenumber", f"SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST({_agg}(l_orderkey) AS BIGINT) AS {_agg}_l_orderkey FROM lineitem GROUP BY 1")
_text("group_f64_minmax", "lineitem", "SELECT MIN(l_extendedprice), MAX(l_extendedprice) GROUP BY l_linenumber", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY 1")
_text("group_str_key", "lineitem", "SELECT SUM(l_orderkey) GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey FROM lineitem GROUP BY 1")
_text("group_filtered_same", "lineitem", "SELECT SUM(l_orderkey) WHERE l_orderkey > 5000 GROUP BY l_linenumber", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey FROM lineitem WHERE l_orderkey > 5000 GROUP BY 1")
_text("group_cross_filtered", "lineitem", "SELECT SUM(l_orderkey) WHERE l_returnflag = 'R' GROUP BY l_linenumber", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
_text("multi_agg_grouped", "lineitem", "SELECT COUNT(l_orderkey), SUM(l_orderkey), MIN(l_partkey), MAX(l_partkey) GROUP BY l_returnflag", "SELECT l_returnflag, count(l_orderkey) AS count_l_orderkey, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey, min(l_partkey) AS min_l_partkey, max(l_partkey) AS max_l_partkey FROM lineitem GROUP BY 1")
_text("top_groups_sum", "orders", "SELECT SUM(o_orderkey) GROUP BY o_custkey ORDER BY SUM DESC LIMIT 10", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_text("top_groups_count", "orders", "SELECT COUNT(o_orderkey) GROUP BY o_custkey ORDER BY o_orderkey DESC LIMIT 7", "SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
_text("having_sum_gt", "orders", "SELECT SUM(o_orderkey) GROUP BY o_custkey HAVING SUM > 100000", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey FROM orders GROUP BY 1 HAVING sum(o_orderkey) > 100000")
_text("having_count_ge", "orders", "SELECT COUNT(o_orderkey) GROUP BY o_custkey HAVING COUNT >= 15", "SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY 1 HAVING count(*) >= 15")
_text("having_between", "orders", "SELECT COUNT(o_orderkey) GROUP BY o_custkey HAVING COUNT BETWEEN 8 AND 10", "SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY 1 HAVING count(*) BETWEEN 8 AND 10")
_text("having_negative", "customer", "SELECT MIN(c_acctbal) GROUP BY c_nationkey HAVING MIN < -900.5", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, min(c_acctbal) AS min_c_acctbal FROM customer GROUP BY 1 HAVING min(c_acctbal) < -900.5")


@_frame("group_dense_with_gaps", "SELECT r.g AS k, coalesce(c, 0) AS count_v, coalesce(s, 0) AS sum_v, mn AS min_v FROM range(13) r(g) LEFT JOIN (SELECT o_orderkey % 7 * 2 AS k, count(*) AS c, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_custkey) AS mn FROM orders GROUP BY 1) ON r.g = k")
def _dense(spark, sf_dir):
    engine = Engine(spark)
    frame = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7 * 2).alias("k"), F.col("o_custkey").alias("v"))
    engine.catalog.register("d", frame, {"k": Kind.U32, "v": Kind.I64})
    return engine.query(Query(((Agg.COUNT, "v"), (Agg.SUM, "v"), (Agg.MIN, "v")), group="k", dense=True))


# projection, row numbers, gather
_text("project_filtered_limit", "lineitem", "SELECT l_orderkey WHERE l_linenumber = 4 LIMIT 50", "SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4 LIMIT 50")
_text("project_all", "customer", "SELECT c_acctbal", "SELECT c_acctbal FROM customer")
_text("project_str_filter", "orders", "SELECT o_orderpriority WHERE o_orderstatus = 'F' LIMIT 20", "SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' LIMIT 20")


@_frame("matching_rows", "SELECT row AS _rid FROM (SELECT row_number() OVER () - 1 AS row, l_quantity FROM lineitem) WHERE l_quantity >= 49 ORDER BY row LIMIT 25")
def _matching(spark, sf_dir):
    return joins.matching_rows(numbered_file(_read(spark, sf_dir, "lineitem")), F.col("l_quantity") >= 49, 25)


@_frame("gather_rows", "SELECT CAST(place AS INT) AS place, l_orderkey AS value FROM (SELECT unnest([0, 1, 2, 3, 4]) AS place, unnest([5, 0, 999, 5, 17]) AS row) JOIN (SELECT row_number() OVER () - 1 AS rid, l_orderkey FROM lineitem) ON row = rid")
def _gather(spark, sf_dir):
    wanted = spark.createDataFrame(list(enumerate([5, 0, 999, 5, 17])), "place int, row long")
    return joins.gather(numbered_file(_read(spark, sf_dir, "lineitem")), "l_orderkey", F.broadcast(wanted))


# joins
_text("join_count_only", "orders customer", "SELECT COUNT(*) JOIN o_custkey = c_custkey", "SELECT count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey")
_text("join_dup_keys", "customer supplier", "SELECT COUNT(*) JOIN c_nationkey = s_nationkey", "SELECT count(*) AS count FROM customer JOIN supplier ON c_nationkey = s_nationkey")
_text("join_agg_scalar", "orders customer", "SELECT SUM(o_orderkey) JOIN o_custkey = c_custkey", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey")
_text("join_pairs_project", "orders customer", "SELECT o_orderkey, c_mktsegment JOIN o_custkey = c_custkey LIMIT 40", "SELECT o_orderkey, c_mktsegment FROM (SELECT *, row_number() OVER () AS l FROM orders) JOIN (SELECT *, row_number() OVER () AS r FROM customer) ON o_custkey = c_custkey ORDER BY r, l LIMIT 40")
_text("star_group", "orders customer", "SELECT SUM(o_orderkey) JOIN o_custkey = c_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_text("star_having", "orders customer", "SELECT COUNT(o_orderkey) JOIN o_custkey = c_custkey GROUP BY c_mktsegment HAVING COUNT > 3000", "SELECT c_mktsegment, count(o_orderkey) AS count_o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 3000")
_text("star_topn", "orders customer", "SELECT SUM(o_orderkey) JOIN o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY SUM DESC LIMIT 3", "SELECT c_mktsegment, CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")


@_frame("join_pairs", "SELECT l AS left_row, r AS right_row FROM (SELECT o_custkey, row_number() OVER () - 1 AS l FROM orders) JOIN (SELECT c_custkey, row_number() OVER () - 1 AS r FROM customer) ON o_custkey = c_custkey")
def _pairs(spark, sf_dir):
    return joins.join_pairs(numbered_file(_read(spark, sf_dir, "orders")), "o_custkey", numbered_file(_read(spark, sf_dir, "customer")), "c_custkey")


# key-value log, transactions, operation stream
def _log(spark, sf_dir):
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("seq"), "event_type")


_LATEST = "SELECT user_id AS key, max(event_id) AS value FROM events GROUP BY 1"
_frame("kv_last_writer_wins", _LATEST)(lambda spark, sf_dir: kv.latest(_log(spark, sf_dir)))
_frame("kv_range", f"SELECT * FROM ({_LATEST}) WHERE key BETWEEN 10 AND 60")(lambda spark, sf_dir: kv.key_range(kv.latest(_log(spark, sf_dir)), 10, 60))
_frame("kv_range_sorted", f"SELECT * FROM ({_LATEST}) WHERE key BETWEEN 10 AND 60 ORDER BY key")(lambda spark, sf_dir: kv.key_range(kv.latest(_log(spark, sf_dir)), 10, 60, ordered=True))
_frame("store_checksum", f"SELECT CAST(sum(value) AS BIGINT) AS checksum FROM ({_LATEST})")(lambda spark, sf_dir: kv.checksum(kv.latest(_log(spark, sf_dir))))


@_frame("wal_replay_txn", """WITH w AS (SELECT user_id AS key, event_id AS value, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'W' WHEN 'view' THEN 'T' WHEN 'error' THEN 'C' END AS op FROM events),
e AS (SELECT *, min(CASE WHEN op = 'C' THEN seq END) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM w WHERE op IS NOT NULL)
SELECT key, arg_max(value, (CASE WHEN op = 'W' THEN seq ELSE c END, seq)) AS value FROM e WHERE op = 'W' OR (op = 'T' AND c IS NOT NULL) GROUP BY key""")
def _replay(spark, sf_dir):
    op = F.when(F.col("event_type") == "purchase", "WRITE").when(F.col("event_type") == "view", "TXN").when(F.col("event_type") == "error", "COMMIT")
    return kv.replay(_log(spark, sf_dir).withColumn("op", op).where("op IS NOT NULL"))


def _operations(spark, sf_dir):
    code = F.when(F.col("event_type") == "purchase", stream.WRITE).when(F.col("event_type") == "error", stream.SCAN).otherwise(stream.READ)
    return _log(spark, sf_dir).withColumn("opcode", code)


_frame("page_binning", "SELECT event_id % 65536 // 64 AS page, count(*) AS n FROM events GROUP BY 1")(lambda spark, sf_dir: _log(spark, sf_dir).groupBy(kv.page_of(F.col("seq")).alias("page")).agg(F.count(F.lit(1)).alias("n")))
_frame("batch_assignment", "SELECT event_id // 512 AS batch_id, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY 1")(lambda spark, sf_dir: stream.batches(_log(spark, sf_dir)).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")))
_frame("opcode_dispatch_counts", "SELECT CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 1 END AS opcode, count(*) AS n FROM events GROUP BY 1")(lambda spark, sf_dir: stream.opcode_counts(_operations(spark, sf_dir)))


@_frame("read_hit_miss", "WITH s AS (SELECT user_id AS key, max(event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id AS seq, user_id AS key, coalesce(s.value, 0) AS value FROM events LEFT JOIN s ON user_id = s.key WHERE event_type = 'view'")
def _reads(spark, sf_dir):
    log = _log(spark, sf_dir)
    return kv.get(kv.latest(log.where("event_type = 'purchase'")), log.where("event_type = 'view'").select("seq", "key"))


@_frame("latency_histogram", "SELECT CAST(b AS INT) AS bucket, n, CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS so_far FROM (SELECT floor(log2(event_id + 1)) AS b, count(*) AS n FROM events GROUP BY 1)")
def _histogram(spark, sf_dir):
    return groups.latency_buckets(_log(spark, sf_dir), "seq")


# dictionaries, appends, snapshots, files
@_frame("dict_encode", "SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def _encode(spark, sf_dir):
    return joins.encode_dictionary(_read(spark, sf_dir, "part"), "p_brand")


@_frame("dict_decode", "SELECT p_partkey, p_brand FROM part")
def _decode(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    codes = joins.encode_dictionary(parts, "p_brand")
    encoded = parts.join(codes, F.col("p_brand") == F.col("value")).select("p_partkey", "code")
    return encoded.join(codes, "code").select("p_partkey", F.col("value").alias("p_brand"))


@_frame("append_union", "SELECT count(v) AS count_v, CAST(sum(v) AS BIGINT) AS sum_v FROM (SELECT o_custkey AS v FROM orders UNION ALL SELECT unnest([7, 8, 9]))")
def _append(spark, sf_dir):
    engine = Engine(spark)
    engine.catalog.register("d", _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("v")), {"v": Kind.U32})
    engine.catalog._numbered["d"] = numbered_file(_read(spark, sf_dir, "orders")).select(RID, F.col("o_custkey").alias("v"))
    engine.append("d", {"v": [7, 8, 9]})
    return engine.sql("SELECT COUNT(v), SUM(v)")


@_frame("snapshot_roundtrip", "SELECT count(c_custkey) AS count_c_custkey, CAST(sum(c_custkey) AS BIGINT) AS sum_c_custkey FROM customer WHERE c_mktsegment >= 'C'")
def _snapshot(spark, sf_dir):
    place = tempfile.mkdtemp(prefix="quernstone-") + "/snapshot"
    _engine(spark, sf_dir, "customer").save(place)
    fresh = Engine(spark)
    fresh.load(place)
    return fresh.sql("SELECT COUNT(c_custkey), SUM(c_custkey) WHERE c_mktsegment >= 'C'")


@_frame("csv_roundtrip", "SELECT s_nationkey AS s_nationkey, count(s_suppkey) AS count_s_suppkey, CAST(sum(s_suppkey) AS BIGINT) AS sum_s_suppkey FROM (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier) GROUP BY 1")
def _csv(spark, sf_dir):
    place = tempfile.mkdtemp(prefix="quernstone-") + "/suppliers"
    _read(spark, sf_dir, "supplier").select(F.concat_ws(",", "s_suppkey", "s_nationkey", "s_acctbal").alias("line")).coalesce(1).write.text(place)
    engine = Engine(spark)
    engine.load_csv(place, {"s_suppkey": (0, "u32"), "s_nationkey": (1, "u32"), "s_acctbal": (2, "f64")})
    return engine.sql("SELECT COUNT(s_suppkey), SUM(s_suppkey) GROUP BY s_nationkey")


RESIDENT, THRESHOLD = 1 << 24, 1 << 23


@_frame("scan_threshold", f"SELECT count(*) AS n, CAST(sum(range) AS BIGINT) AS total, min(range) AS low, max(range) AS high FROM range({RESIDENT}) WHERE range > {THRESHOLD}")
def _scan(spark, sf_dir):
    """The resident column 0, 1, 2, ... scanned for values over a threshold, all aggregates in one pass."""
    v = F.col("id")
    return spark.range(RESIDENT).where(matches(v, Kind.U32, Cmp.GT, THRESHOLD)).agg(*[aggregate(a, v, Kind.U32).alias(n) for n, a in _TERMS])


@_frame("scan_accounting", f"SELECT 10 * count(*) AS scanned FROM range({RESIDENT}) WHERE range > {THRESHOLD}")
def _accounting(spark, sf_dir):
    """Ten threshold scans, one in each thousand of ten thousand operations."""
    scans = spark.range(10_000).where("id % 1000 = 999").count()
    return spark.range(RESIDENT).where(F.col("id") > THRESHOLD).agg((F.count(F.lit(1)) * scans).alias("scanned"))


@_frame("two_dataset_alignment", "SELECT CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey FROM (SELECT o_custkey, row_number() OVER () AS r FROM orders) JOIN (SELECT o_orderstatus AS s, row_number() OVER () AS r FROM orders) USING (r) WHERE s = 'O'")
def _aligned(spark, sf_dir):
    """A filter on a column of another dataset, which joins by row number."""
    engine = _engine(spark, sf_dir, "orders")
    engine.catalog.register("other", _read(spark, sf_dir, "orders").select("o_orderstatus"), {"o_orderstatus": Kind.STR})
    engine.catalog._numbered["other"] = numbered_file(_read(spark, sf_dir, "orders")).select(RID, "o_orderstatus")
    return engine.sql("SELECT SUM(o_custkey) WHERE o_orderstatus = 'O'")


@_frame("wal_replay_by_transaction", """WITH w AS (SELECT user_id AS key, event_id AS value, event_id AS seq, event_id // 10 AS txn, CASE event_type WHEN 'purchase' THEN 'W' WHEN 'view' THEN 'T' WHEN 'error' THEN 'C' END AS op FROM events),
c AS (SELECT txn, max(seq) AS e FROM w WHERE op = 'C' GROUP BY txn),
u AS (SELECT key, value, seq, seq AS e FROM w WHERE op = 'W' UNION ALL SELECT key, value, seq, c.e FROM w JOIN c ON w.txn = c.txn WHERE op = 'T')
SELECT key, arg_max(value, (e, seq)) AS value FROM u GROUP BY key""")
def _replay_by_txn(spark, sf_dir):
    op = F.when(F.col("event_type") == "purchase", "WRITE").when(F.col("event_type") == "view", "TXN").when(F.col("event_type") == "error", "COMMIT")
    return kv.replay_by_transaction(_log(spark, sf_dir).withColumn("op", op).withColumn("txn", F.expr("seq div 10")).where("op IS NOT NULL"))


@_frame("tier_plan")
def _tiers(spark, sf_dir):
    """Heat and tier of three columns over a trace of scans with room for two of them."""
    from ..tiering import COLD, HOST, Tiering

    tiers, rows = Tiering(budget=2_000_000), []
    for name, tier in (("a", HOST), ("b", HOST), ("c", COLD)):
        tiers.add(name, 1_000_000, tier)
    for step, name in enumerate("abccccccccccaccc"):
        tiers.scanned(name)
        rows += [(step, n, i.tier, float(i.heat)) for n, i in tiers.items.items()]
    return spark.createDataFrame(rows, "step int, name string, tier string, heat double")


@_frame("stream_pipeline", "SELECT user_id AS key, max(event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def _stream(spark, sf_dir):
    place = tempfile.mkdtemp(prefix="quernstone-")
    _operations(spark, sf_dir).select("seq", "opcode", "key", "value").repartitionByRange(3, "seq").write.parquet(f"{place}/in")
    pipe = stream.Pipeline(spark, f"{place}/out", spark.range(1000).select(F.col("id").alias("v")), 500)
    pipe.start(f"{place}/in").awaitTermination()
    return pipe.final_state()


# keys of 64 bits, facts with repeated keys, rows joined and then gathered
_text("join_i64_count", "lineitem orders", "SELECT COUNT(*) JOIN l_orderkey = o_orderkey", "SELECT count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
_text("join_i64_sum", "lineitem orders", "SELECT SUM(l_partkey) JOIN l_orderkey = o_orderkey", "SELECT CAST(sum(l_partkey) AS BIGINT) AS sum_l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
_text("join_fact_keys", "lineitem supplier", "SELECT COUNT(*) JOIN l_suppkey = s_suppkey", "SELECT count(*) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")


@_frame("join_then_gather", "SELECT l AS place, o_totalprice AS value FROM (SELECT o_custkey, o_totalprice, row_number() OVER () - 1 AS l FROM orders) JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _join_gather(spark, sf_dir):
    """Rows of orders whose customer is in one segment, found by a join and fetched by number."""
    orders = numbered_file(_read(spark, sf_dir, "orders"))
    chosen = numbered_file(_read(spark, sf_dir, "customer")).where("c_mktsegment = 'BUILDING'")
    found = joins.join_pairs(orders, "o_custkey", chosen, "c_custkey")
    return joins.gather(orders, "o_totalprice", found.select(F.col("left_row").alias("place"), F.col("left_row").alias("row")))


_BRANDS = "SELECT p_brand AS v, row_number() OVER (ORDER BY p_brand) - 1 AS c FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0 AND p_brand > 'Brand#2')"


@_frame("dict_encode_absent", f"WITH d AS ({_BRANDS}) SELECT p_partkey, coalesce(c, (SELECT count(*) FROM d)) AS code FROM part LEFT JOIN d ON p_brand = v")
def _encode_absent(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    codes = joins.encode_dictionary(parts.where("p_partkey % 2 = 0 AND p_brand > 'Brand#2'"), "p_brand")
    return joins.encode_values(parts.select("p_partkey", "p_brand"), "p_brand", codes).select("p_partkey", "code")


@_frame("dict_decode_absent", f"WITH d AS ({_BRANDS}) SELECT p_partkey, coalesce(v, '') AS value FROM part LEFT JOIN d ON p_partkey % 40 = c")
def _decode_absent(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    codes = joins.encode_dictionary(parts.where("p_partkey % 2 = 0 AND p_brand > 'Brand#2'"), "p_brand")
    return joins.decode_values(parts.select("p_partkey", (F.col("p_partkey") % 40).cast("long").alias("code")), codes).select("p_partkey", "value")


@_frame("column_fingerprint", "SELECT CAST(coalesce(sum(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS checksum FROM orders")
def _fingerprint(spark, sf_dir):
    return kv.fingerprint(_read(spark, sf_dir, "orders"), "o_custkey")


@_frame("csv_str_i64", "SELECT e AS event_type, count(v) AS count_v, CAST(sum(v) AS BIGINT) AS sum_v FROM (SELECT event_type AS e, 1000 - event_id AS v FROM events) GROUP BY 1")
def _csv_kinds(spark, sf_dir):
    place = tempfile.mkdtemp(prefix="quernstone-") + "/events"
    _read(spark, sf_dir, "events").select(F.concat_ws(";", (1000 - F.col("event_id")).cast("string"), "event_type").alias("line")).write.text(place)
    engine = Engine(spark)
    engine.load_csv(place, {"v": (0, "i64"), "event_type": (1, "str")}, delimiter=";")
    return engine.sql("SELECT COUNT(v), SUM(v) GROUP BY event_type")


@_frame("column_file_roundtrip", "SELECT count(o_totalprice) AS count_o_totalprice, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders")
def _column_file(spark, sf_dir):
    place = tempfile.mkdtemp(prefix="quernstone-") + "/price"
    _engine(spark, sf_dir, "orders").save_column("o_totalprice", place)
    fresh = Engine(spark)
    fresh.load_column(place)
    return fresh.sql("SELECT COUNT(o_totalprice), MIN(o_totalprice), MAX(o_totalprice)")


_STORED = "SELECT user_id AS key, max(event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1"


def _store(spark, sf_dir, capacity=1 << 40):
    from ..sources.store import Store

    store = Store(spark, tempfile.mkdtemp(prefix="quernstone-") + "/kv", capacity)
    store.write(_log(spark, sf_dir).where("event_type = 'purchase'"))
    return store


@_frame("store_checkpoint_recovery", f"SELECT key, CASE key WHEN 3 THEN -3 ELSE value END AS value FROM ({_STORED} UNION ALL SELECT -1, 10) UNION ALL SELECT 3, -3 WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = 3 AND event_type = 'purchase')")
def _recovered(spark, sf_dir):
    """A bulk write, a checkpoint, puts after it, and another store that opens the folder."""
    store = _store(spark, sf_dir)
    store.checkpoint()
    store.put(-1, 10)
    store.put(3, -3)
    return type(store)(spark, store.path).state()


@_frame("store_transactions", f"SELECT * FROM ({_STORED}) UNION ALL SELECT -1, 11 UNION ALL SELECT -2, 20")
def _transactions(spark, sf_dir):
    """One transaction that is committed, one that is rolled back and one that a crash leaves open."""
    store = _store(spark, sf_dir)
    for key, value, end in ((-1, 11, store.commit), (-5, 50, store.rollback), (-2, 20, store.commit), (-6, 60, None)):
        store.begin()
        store.txn_put(key, value)
        if end:
            end()
    return type(store)(spark, store.path).state()


@_frame("store_capacity", f"SELECT * FROM ({_STORED}) WHERE key IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY min(event_id), 1 LIMIT 20)")
def _capacity(spark, sf_dir):
    """New keys beyond the store's capacity are dropped, the first to come stay."""
    return _store(spark, sf_dir, 20).state()
