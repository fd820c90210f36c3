from quernstone.llm.exact_dedup import exact_dedup, keep_first

ROWS = [(1, "Ab c", "x"), (2, "aB C", "x"), (3, "É", None), (4, "é", ""), (5, None, "s"), (6, "", "s"), (7, "ab c", "t"), (7, "ab c", "t"), (None, "ab c", "u"), (8, "w " * 50_000, "v")]
SCHEMA = "doc_id long, text string, digest string"


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = {}
    for i, text, _ in ROWS:
        groups.setdefault((text or "").translate(lower), []).append(i)
    want = sorted(((i, max(x for x in g if x is not None), len(g), i == max(x for x in g if x is not None)) for g in groups.values() for i in g), key=str)
    got = exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == want


def test_hot_group_and_repeated_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) as text")
    got = exact_dedup(docs).where("text_sha256 = sha2('same', 256)")
    assert got.count() == 1000 and [r.doc_id for r in got.where("kept").collect()] == [2997]


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(docs).collect() == []
    kept = keep_first(spark.createDataFrame(ROWS[:4], SCHEMA))
    assert kept.columns == ["doc_id", "text", "digest"] and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_texts_of_one_digest_are_told_apart_by_content(spark, monkeypatch):
    from pyspark.sql import functions as F
    from quernstone.llm import exact_dedup as E

    plain = E._rows
    monkeypatch.setattr(E, "_rows", lambda *a: plain(*a).withColumn("digest", F.when(F.col("content").isin("x", "y"), F.lit("same")).otherwise(F.col("digest"))))
    docs = spark.createDataFrame([(1, "x"), (2, "X"), (3, "y"), (4, "z"), (5, "Y"), (6, "w")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(docs).collect()) == [(1, 2, 2), (2, 2, 2), (3, 5, 2), (4, 4, 1), (5, 5, 2), (6, 6, 1)]


def test_one_row_of_each_group_is_kept_and_names_may_have_dots(spark):
    docs = spark.createDataFrame([(7, "x one", 1), (7, "y two", 2), (7, "x one", 3), (None, "q", 4), (None, "q", 5), (1, "X ONE", 6)], "`a.id` long, `t.x` string, keep_id int")
    kept = keep_first(docs, "a.id", "t.x")
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(7, "x one"), (7, "y two"), (None, "q")], key=str)
    assert exact_dedup(docs, "a.id", "t.x").count() == 6
