import random
import re

from quernstone.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=8):
    out = {}
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, test in items:
            t = split(test)
            k = min(window, len(t))
            for i in range(len(t) - k + 1 if k else 0):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == t[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add(str(item))
        out[doc] = (len(words), len(hit), len(found), D.items_digest(found), len(found) >= 2)
    return out


def case(seed):
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "7"]) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, pick(rng.choice([0, 1, 3, 7, 8, 9, 14, 20]) if i > 3 else 12)) for i in range(10)] + [(3, pick(9)), (11, None)]
    docs = [(i, pick(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "")) for i in range(40)] + [(98, None), (99, "")]
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        items = [x for x in items if len(split(x[1])) > 5 or seed == 1]
        got = D.contamination_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs, items)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = case(3)
    monkeypatch.setattr(D.item_blocks, "__defaults__", ("item_id", "text", 60))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sum(1 for _ in D.item_blocks(bench)) > 2
    got = D.contamination_digest(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs, items)


def test_spans_are_cut_and_clean_rows_stay(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, f"Before this all is well and it stays so. {item.title()}! After it comes more.", "x", 5), (2, item, "x", 5), (3, "clean text", None, None), (4, None, "y", 1), (4, None, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leak string, n_words int")
    got = D.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "Before this all is well and it stays so. ! After it comes more.", "x", 5), *rows[2:]], key=str)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination_digest(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b")], docs.schema)
    assert [tuple(r)[:4] for r in D.contamination_digest(one, bench).collect()] == [(1, 2, 0, 0)]


def test_one_repeated_word_takes_linear_time():
    import time

    auto = D.SuffixAutomaton([("a", [b"ho"] * 3000), ("b", [b"ho"] * 3), ("c", [b"x", b"ho"] * 400)])
    began = time.process_time()
    hit, found = auto.hits([b"ho"] * 200_000 + [b"x", b"ho"] * 50_000)
    assert time.process_time() - began < 20 and hit.all() and found == {"a", "b", "c"}


def test_a_column_named_like_the_result_is_replaced(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight", "old", 3)], "doc_id long, text string, leak string, starts int")
    items = spark.createDataFrame([("i", "two three four five six seven eight nine"), ("j", "seven eight")], "item_id string, text string")
    got = D.find_contamination(docs, items)
    assert got.columns == ["doc_id", "text", "starts", "leak"] and got.first().leak.items == ["j"] and got.first().starts == 3
    left = D.decontaminate(docs, items).collect()
    assert [tuple(r) for r in left] == [(1, "one two three four five six ", "old", 3)]
