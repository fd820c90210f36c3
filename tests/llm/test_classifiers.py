import random
import zlib

import numpy as np
import pytest

from quernstone.llm import features, quality, toxicity

WORDS = [a + b for a in ("ber", "tion", "the", "an", "or", "ch") for b in ("a", "en", "il", "os", "ud", "é")]


def corpus(n=700, seed=2):
    """Texts of random words; toxic ones hold slurs with one of two stems, poor ones shout or stutter."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "ly", "er"]) for _ in range(rng.randint(8, 150))]
        toxic, poor = int(rng.random() < 0.25), int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["zzgrk", "qvlox"]) + rng.choice(WORDS))
        if poor:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else words + [words[3]] * (3 * len(words))
        out.append((i, " ".join(words), 1 - poor, toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "src") for i, t, _, _ in rows] + [(9001, None, None), (9002, "", None), (9003, " .,- ", None), (None, "some words", None), (9004, "x " * 60_000, None), (9004, "x " * 60_000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs.repartition(3), labels, rows


def test_training_rows_are_bounded_and_leave_out_the_held_out(tables):
    docs, labels, rows = tables
    texts = {t.encode(): q for i, t, q, _ in rows if zlib.crc32(str(i).encode()) % 5}
    got = features.training_rows(docs, labels, "quality", 100)
    assert len(got) == 100 and all(texts[t] == y for t, y in got)
    assert len(features.training_rows(docs, labels, "quality")) == len(texts)


@pytest.mark.parametrize(("score", "label", "threshold"), [(quality.score_quality, 2, 0.3), (toxicity.score_toxicity, 3, 0.5)])
def test_held_out_accuracy_and_edge_rows(tables, score, label, threshold):
    docs, labels, rows = tables
    got = score(docs, labels).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    by = {r.doc_id: r for r in got}
    test = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 5]
    assert all(by[r[0]].held_out for r in test) and by[None].held_out is None
    right = np.mean([by[r[0]].predicted == r[label] for r in test])
    assert right >= 0.95, right
    assert len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1 and len({r.score for r in got if r.doc_id == 9004}) == 1


def test_rejected_rows_go(tables):
    docs, labels, rows = tables
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    toxic = {r[0] for r in rows if r[3]}
    assert ids.count(9004) == 2 and None in ids and len(toxic & set(ids)) <= 0.1 * len(toxic) and len(set(ids) - toxic) >= 0.97 * (len(rows) - len(toxic))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, labels).collect() == toxicity.score_toxicity(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a b")], docs.schema)
    assert quality.score_quality(one, labels).first().score == 0.5 and toxicity.score_toxicity(one, labels).count() == 1


def test_toxicity_is_learned_by_the_network_from_words_and_characters():
    """Held-out ranking with learned inputs only; without its inputs the network knows nothing, and unseen spellings
    of a learned stem are found by their characters."""
    rows = corpus(900, 11)
    train = [(t.encode(), y) for i, t, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    test = [(t.encode(), y) for i, t, _, y in rows if not zlib.crc32(str(i).encode()) % 5]
    net = toxicity.fit(train)

    def auc():
        scores, y = net.scores([t for t, _ in test]), np.array([y for _, y in test])
        rank = np.argsort(np.argsort(scores, kind="stable"), kind="stable")
        return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))

    assert auc() >= 0.95
    plain = " ".join(WORDS)
    new, clean = net.scores([f"{plain} zzgrkzzgrk qvloxqvlox {plain}".encode(), plain.encode()])
    assert new > 0.5 > clean
    net.p["word"][:], net.p["gram"][:] = 0, 0
    assert np.ptp(net.scores([t for t, _ in test])) < 0.1  # nothing else tells texts apart


def test_gradients_equal_differences():
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, toxicity._INPUTS)).astype(np.float32)
    rows = rng.integers(0, 9, (4, toxicity.LENGTH))
    rows[1, 20:], rows[3, 1:] = -1, -1
    slope = np.array([0.3, -1.0, 0.5, 2.0], np.float32)
    keep: dict = {}
    net.run(net.projected(x), rows, keep)
    grads, to_x = net.gradients(keep, rows, x, slope)
    loss = lambda: float(net.run(net.projected(x), rows) @ slope)

    def check(table, grad):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        was, eps = table[at], 1e-2
        table[at] = was + eps
        up = loss()
        table[at] = was - eps
        down = loss()
        table[at] = was
        assert abs((up - down) / (2 * eps) - grad[at]) <= 0.03 * abs(grad[at]) + 2e-3

    for name, grad in grads.items():
        check(net.p[name], grad)
    check(x, to_x)


def test_chunked_words_equal_whole():
    texts = [t.encode() for _, t, _, _ in corpus(80)]
    a, b = toxicity.Words(texts), toxicity.Words.of_many(texts, 3000)
    assert (a.index == b.index).all() and (a.gram == b.gram).all() and (a.hashes == b.hashes).all() and (a.doc_starts == b.doc_starts).all()


def test_windows_cover_every_word():
    words = toxicity.Words([b"w " * n for n in (0, 1, 31, 32, 33, 48, 49, 200)])
    start, size, doc = words.windows()
    seen = np.zeros(len(words.index), int)
    for s, n in zip(start, size, strict=True):
        assert n <= toxicity.LENGTH
        seen[s : s + n] += 1
    assert (seen >= 1).all() and 0 not in doc
