import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from quernstone.llm import pieces as P


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


def texts():
    rng = random.Random(11)
    yield from (None, "", " ", "  ", " " * 37, "a", "  a  b ", "a\tb\nc\r\n", "▁x ▁▁ y▁", "ﬁ Ａ é é", "\x00a\x7f", "日本語 テスト", "🙂🙃 ok", "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaa", "ha" * 300, "=" * 129, "-" * 64 + " " * 65 + "#" * 31, "0123456789" * 40, "x" * 3000)
    alphabet = ["the", "tion", "er", "a", "A", " ", "  ", ".", ",", "é", "ß", "ñ", "0", "12", "\n", "▁", "本", "🙂", "ä", "!!", "$$$", "\t", "http://", "</"]
    for _ in range(1500):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
    for _ in range(300):
        yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x370, 0x2FFF)])) for _ in range(rng.randint(1, 60)))


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return np.array(ids, "<u4").tobytes(), library.decode(ids)


def test_equals_the_library(library):
    rows = list(texts())
    coder = P.Encoder(P.model_path())
    for text, ids in zip(rows, coder.encode(rows), strict=True):
        want, decoded = expected(library, text)
        assert ids == want, repr(text)
        assert coder.decode(ids).decode() == decoded


def test_long_words_by_a_heap_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(P, "LONG_WORD", 2)
    rows = list(texts())
    for text, ids in zip(rows, P.Encoder(P.model_path()).encode(rows), strict=True):
        assert ids == expected(library, text)[0], repr(text)


@pytest.mark.parametrize("kind", ["letters", "one", "spaces", "strange", "word"])
def test_a_million_characters_in_one_run(library, kind):
    import time

    rng = random.Random(3)
    text = {"letters": lambda: "".join(rng.choices("etaoinshr", k=300_000)), "one": lambda: "a" * 1_000_000, "spaces": lambda: " " * 1_000_000 + "x", "strange": lambda: "\u1234\u4321" * 200_000, "word": lambda: "tion " * 200_000}[kind]()
    began = time.process_time()
    (ids,) = P.Encoder(P.model_path()).encode([text])
    assert time.process_time() - began < 60
    assert ids == expected(library, text)[0]


def test_small_cache_gives_the_same(library):
    rows = [t for t in texts() if t][:300]
    coder = P.Encoder(P.model_path(), cache_words=50)
    got = [x for at in range(0, len(rows), 7) for x in coder.encode(rows[at : at + 7])]
    assert got == [expected(library, t)[0] for t in rows]


def test_digest_and_operator(spark, library):
    rows = [*enumerate([*list(texts())[:60], "long text " * 20_000]), (5, "again"), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    want = []
    for i, t in rows:
        ids, decoded = expected(library, t)
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, P.piece_digest(docs).collect()), key=str) == sorted(want, key=str)
    full = P.encode_decode(docs)
    assert full.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert {(r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in full.collect()} == {(w[0], w[2]) for w in want}


def test_empty(spark):
    assert P.piece_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
