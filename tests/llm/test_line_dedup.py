import random
import re

import pytest

from quernstone.llm import line_dedup as L


def sets_of(text):
    return [frozenset(w for w in re.split(r"[ \t-\r]+", line) if w) for line in text.split("\n")]


def brute(rows):
    """rows: (doc_id, text), any number of rows of one key; a null key comes first."""
    rank = lambda i: (i is not None, i or 0)
    every = [(rank(i), at, s) for i, t in rows if t is not None for at, s in enumerate(sets_of(t)) if s]
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept = []
        for at, s in enumerate(sets_of(t)):
            gone = any((r, a) < (rank(i), at) and 5 * len(s & o) >= 4 * len(s | o) for r, a, o in every) if s else False
            if not gone:
                kept.append(t.split("\n")[at])
        lines = t.count("\n") + 1
        out.append((i, "\n".join(kept), lines, lines - len(kept)))
    return out


def case(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "und"] * 15
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 12, 20, 30]))] for _ in range(30)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rng.shuffle(line)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((i, "\n".join(lines)))
    return [*rows, (7, rows[3][1]), (8, rows[8][1]), (None, rows[5][1] + "\nnull key line of its own here"), (90, None), (91, ""), (92, "\n \n\t"), (93, "long line " + "x y z " * 20_000)]


@pytest.fixture(autouse=True)
def small_bitmaps(monkeypatch):
    monkeypatch.setattr(L, "SEEN_LOG2", 16)


def compare(spark, rows):
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    got = L.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_against_brute_force(spark):
    compare(spark, case(1))


def test_hot_words_are_refined_without_loss(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_LOG2", 0)
    compare(spark, case(2, 60))
    monkeypatch.setattr(L, "LONG", 8)
    compare(spark, case(4, 60))


@pytest.mark.parametrize(("crowd", "sure"), [(2, 250), (1, 2)])
def test_crowds_meet_their_earliest_first(spark, monkeypatch, crowd, sure):
    monkeypatch.setattr(L, "CROWD", crowd)
    monkeypatch.setattr(L, "SURE", sure)
    monkeypatch.setattr(L, "WIDE", 6)
    rng = random.Random(5)
    base = [f"c{k}" for k in range(24)]
    crowd_rows = []
    for i in range(40):
        line = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            line[rng.randrange(24)] = f"o{rng.randrange(30)}"
        crowd_rows.append((200 + i, " ".join(line) + "\n" + " ".join(line[:12])))
    compare(spark, crowd_rows + case(6, 20))


def test_unlikely_likely_matches_are_held_against_all(spark, monkeypatch):
    """Parities that say nothing make wrong guesses, which the words correct."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "CROWD", 1)
    monkeypatch.setattr(L, "_parity", lambda hashes: F.lit(0).cast("long"))
    compare(spark, case(8, 40))


def classes_of(spark, lines):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(2)
    found = L.lines(L.marked(docs, "doc_id", "text"))
    return L.keyed(found, L.rarity(found)).withColumn("cid", F.col("id"))


@pytest.mark.parametrize(("hot", "long"), [(9, 250), (0, 250), (0, 20)])
def test_near_copies_meet_once(spark, monkeypatch, hot, long):
    """At the first of a run of common words, plain, in pairs of hot words, or hot and alone; not at each of the prefix."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(type(spark.range(1)), "distinct", lambda self: self)
    monkeypatch.setattr(L, "HOT_LOG2", hot)
    monkeypatch.setattr(L, "LONG", long)
    shared = " ".join(f"c{k}" for k in range(30))
    classes = classes_of(spark, [f"{shared} {' '.join(f'often{j}' for j in range(14) if j != i)}" for i in range(10)] + [f"often{j} " * 99 for j in range(14)])
    pairs = [tuple(r) for r in L.met(L.meetings(classes.where("id < 10"), F.lit(True))).collect()]
    assert sorted(pairs) == [(x, y) for x in range(10) for y in range(x)]


def test_a_class_has_several_likely_matches(spark, monkeypatch):
    monkeypatch.setattr(L, "CROWD", 2)
    shared = " ".join(f"c{k}" for k in range(40))
    got = L.earliest(classes_of(spark, [f"{shared} own{i}" for i in range(12)]), []).collect()
    assert len({r.cid for r in got}) >= 10 and len({r.y for r in got}) > 1
    assert all(r.y < r.cid for r in got) and len(got) == len(set(got)) > 12


def test_shared_rare_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "RARITY_LOG2", 11)
    compare(spark, case(3))


def test_other_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same line here\nown", "a", 1), (2, "other\nsame line here", "b", None)], "doc_id long, text string, id string, at int")
    got = {r.doc_id: tuple(r) for r in L.dedup_lines(docs).collect()}
    assert got == {1: (1, "same line here\nown", "a", 1, 2, 0), 2: (2, "other", "b", None, 2, 1)}
    assert L.dedup_lines(spark.createDataFrame([], docs.schema)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(case(1)[:5], "doc_id long, text string").repartition(2)
    plan = L.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
