import os
import random

import numpy as np
import pytest

from quernstone.llm import token_output as T


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_and_inverse(size):
    out = T.permuted(np.arange(size), size)
    assert sorted(out.tolist()) == list(range(size))
    assert (T.permuted(out, size, inverse=True) == np.arange(size)).all()
    if size > 100:
        assert (out != T.permuted(np.arange(size), size, key=1)).mean() > 0.9


def rows():
    rng = random.Random(4)
    for i in range(60):
        yield i, " ".join(rng.choice(["the", "tion", "öffnen", "本", "x1", "\n"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))
    yield from ((60, None), (61, ""), (5, "again"), (5, "again"), (None, "no key"), (62, "long " * 9000))


def test_round_trip(spark, tmp_path):
    table = list(rows())
    docs = spark.createDataFrame([(i, t, b"x") for i, t in table], "doc_id long, text string, tokens binary").repartition(3)
    got = T.materialise(docs, length=64, per_shard=16)
    found = sorted(got.collect())
    assert [r.slot for r in found] == list(range(len(found)))
    assert all(len(r.tokens) == 128 and r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 128 and 0 < r.n_tokens <= 64 for r in found)
    encoding = T._encoding(T.VOCABULARY)
    number = T.permuted(np.arange(len(found)), len(found), inverse=True)
    stream, texts, owners = [], [], []
    for k in np.argsort(number):
        stream += np.frombuffer(found[k].tokens, T.DTYPE)[: found[k].n_tokens].tolist()
    at = 0
    for k, t in enumerate(stream):
        if t == T.SEPARATOR:
            texts.append(encoding.decode(stream[at:k]))
            at = k + 1
    assert at == len(stream) and sorted(texts) == sorted(t or "" for _, t in table)
    for r in found:
        owners += r.doc_ids
    assert {x for x in owners} == {i for i, _ in table}
    long = [r for r in found if 62 in r.doc_ids]
    assert len(long) >= 9000 // 64


def test_shards_are_written_and_resumed(spark, tmp_path):
    docs = spark.createDataFrame(list(rows()), "doc_id long, text string").repartition(2)
    got = T.materialise(docs, length=64, per_shard=16)
    want = [r.tokens for r in sorted(got.collect())]
    about = T.finish([T.write_shards(got, f"file://{tmp_path}/out")], f"{tmp_path}/out", 64, 16)
    assert about["total"] == len(want) and [s[0] for s in about["shards"]] == list(range(-(-len(want) // 16)))
    for start in (0, 1, 16, 37, len(want) - 1, len(want)):
        assert [x.tobytes() for x in T.read_slots(f"{tmp_path}/out", start)] == want[start:]
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".shard")]


def test_doc_ids_name_the_rows_of_each_sequence():
    import pyarrow as pa

    packer, rng, out = T.Packer(10), random.Random(1), []
    sizes = [rng.choice([1, 2, 9, 10, 11, 35]) for _ in range(200)]
    for i in range(0, 200, 7):
        packer.add([np.full(n, i + k, T.DTYPE) for k, n in enumerate(sizes[i : i + 7])], pa.array(range(i, min(i + 7, 200))))
        if found := packer.take():
            out += zip(*found[:2], found[2].to_pylist(), strict=True)
    out += zip(*(lambda f: (f[0], f[1], f[2].to_pylist()))(packer.take(True)), strict=True)
    for tokens, n, ids in out:
        assert ids == sorted(set(np.frombuffer(tokens, T.DTYPE)[:n].tolist()))
    assert sum(n for _, n, _ in out) == sum(sizes)


def test_empty(spark):
    assert T.materialise(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_returns_what_its_shards_hold(spark, tmp_path):
    from quernstone.llm.registry import QUERIES

    table = spark.createDataFrame(list(rows()), "doc_id long, text string").repartition(2)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, T.materialise(docs, length=64, per_shard=16).collect()))
    got = sorted(map(tuple, T.stored(docs, length=64, per_shard=16, folder=f"file://{tmp_path}/out").collect()))
    assert got == want and [x.tobytes() for x in T.read_slots(f"{tmp_path}/out")] == [r[-1] for r in want]
    place = T._folder(T.shared_folder(spark))
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    found = sorted(QUERIES["op9_token_output"](spark, str(tmp_path)).collect())
    (made,) = [x for x in set(os.listdir(place)) - before if x.startswith("shards-")]
    assert [x.tobytes() for x in T.read_slots(f"{place}/{made}")] == [r.tokens for r in found]
    assert T.stored(docs.limit(0), folder=f"{tmp_path}/none").collect() == []


def test_slots_do_not_depend_on_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BUCKET_BYTES", 3000)
    docs = spark.createDataFrame(list(rows()), "doc_id long, text string")
    for n in (2, 7):
        T.stored(docs.repartition(n), length=64, per_shard=16, folder=f"file://{tmp_path}/{n}", passes=3).collect()
    names = sorted(p.name for p in (tmp_path / "2").iterdir())
    assert len(names) > 4 and names == sorted(p.name for p in (tmp_path / "7").iterdir())
    assert all((tmp_path / "2" / x).read_bytes() == (tmp_path / "7" / x).read_bytes() for x in names)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a" * 300_000, "ab " * 300_000, "\n \t" * 300_000 + "end"])
def test_texts_of_a_million_characters(text):
    ids = T.token_ids(text)
    assert T._encoding(T.VOCABULARY).decode(ids) == text


def test_long_runs_of_space_give_the_ids_of_the_plain_way(monkeypatch):
    texts = ["a  b", " " * 30 + "x y", "x\n\n  \ty ", "  ", "it's 12  é本" + " " * 9]
    want = [T.token_ids(t) for t in texts]
    monkeypatch.setattr(T, "_LONG_SPACE", T.re.compile(""))
    monkeypatch.setattr(T, "len", lambda x: 1 << 20, raising=False)
    assert [T.token_ids(t) for t in texts] == want
