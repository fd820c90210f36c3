import itertools
import random

import numpy as np
import xxhash

import corpus_pipeline
from quernstone.llm import simhash as S


def plain_fingerprint(text, size=4):
    words = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, radius=4):
    """prints: list of (id, fp); component as the least id reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3, 4):
        cover = S.masks(radius)
        assert len(cover) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        every = itertools.chain.from_iterable(itertools.combinations(range(64), w) for w in range(1, min(radius, 2) + 1))
        for bits in itertools.chain(every, (rng.sample(range(64), radius) for _ in range(3000))):
            diff = sum(1 << b for b in bits)
            assert any(not diff & m for m in cover)


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One two", "A b C d", "Ä ö ü x y", "w " * 20_000, *(" ".join(rng.choice("abcdefg") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    for t in texts:
        assert S.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_links_equal_brute_force_with_chunked_buckets(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(120)}
    for v in list(values)[:12]:
        for _ in range(30):
            w = v
            for b in rng.sample(range(64), rng.randint(1, 5)):
                w ^= 1 << b
            values.add(w)
    prints = list(enumerate(sorted(values)))
    signed = [(int(np.uint64(v).view(np.int64)),) for _, v in prints]
    for chunk in (4, 2048):
        found = S.stars(S.links(spark.createDataFrame(signed, "fp long"), 4, chunk)).collect()
        roots = {r.a: r.b for r in found}
        label = [roots.get(s[0], s[0]) for s in signed]
        want = brute(prints)
        assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))


def test_components_end_to_end(spark):
    rng = random.Random(1)
    base = [" ".join("w" + str(rng.randint(0, 5000)) for _ in range(200)) for _ in range(8)]
    texts = [*base, *(b.upper() for b in base[:3]), *(b + " tail" for b in base[:5]), None, "", "  ", "x y"]
    rows = [*enumerate(texts, 10), (None, base[0]), (10, base[0]), (None, "only null key here")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = S.simhash_digest(docs).collect()
    want = list(zip(((i, f"{plain_fingerprint(t):016x}") for i, t in rows), brute([(i, plain_fingerprint(t)) for i, t in rows]), strict=True))
    assert sorted(map(tuple, got), key=str) == sorted(((i, f, c) for (i, f), c in want), key=str)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want} | {None}


def test_long_chain_and_empty(spark):
    chain = spark.range(1, 60).selectExpr("id as a", "id - 1 as b")
    assert {(r.a, r.b) for r in S.stars(chain).collect()} == {(i, 0) for i in range(1, 60)}
    assert S.simhash_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similar_finds_every_pair_of_the_asked_jaccard(spark):
    rng = random.Random(5)
    base = [["w" + str(rng.randint(0, 3000)) for _ in range(rng.choice([12, 60, 250]))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for swaps in (1, 1, 2, 3, 4, 5, 6):
            words = list(b)
            for at in rng.sample(range(len(words)), swaps):
                words[at] = "v" + str(rng.randint(0, 99999))
            texts.append(" ".join(words))
    passage = " ".join("p" + str(i) for i in range(14))
    texts += [f"{passage} " + " ".join("q" + str(rng.randint(0, 3000)) for _ in range(20)) for _ in range(60)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    missed = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            missed += (S.fingerprint(texts[i].encode(), 5) ^ S.fingerprint(texts[j].encode(), 5)).bit_count() > 4
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert missed > 20  # pairs that four bits of a fingerprint do not reach
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for chunk in (4, 2048):
        found = {r.id: r.component for r in S.similar(docs, "doc_id", "text", 5, 0.8, chunk=chunk).collect()}
        label = [found[i] for i in range(len(texts))]
        want = [find(i) for i in range(len(texts))]
        assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in range(len(texts))})
    for t in (None, "", "a", "A b c d e", "a b c d e f f f f f f f f"):
        words = (t or "").lower().split()
        assert S.shingles((t or "").encode(), 5).tolist() == sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), seed=42) for i in range(max(1, len(words) - 4)) if words})


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join("w" + str(rng.randint(0, 5000)) for _ in range(120)) for _ in range(4))
    rows = [(1, a, "x"), (1, a, "x"), (3, b, "x"), (7, b + " tail", "x"), (7, d, "x"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (None, c + " tail", "x"), (9, None, "x"), (9, "", "x"), (None, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string").repartition(3)
    for options in ({}, {"shingle": 5, "similarity": 0.8}):
        kept = S.keep_one(docs, **options)
        assert kept.columns == docs.columns
        found = kept.collect()
        assert sorted((r.doc_id or 0) for r in found) == [0, 1, 3, 7, 9]
        assert {r.doc_id: r.text for r in found if r.doc_id in (1, 3, 7)} == {1: a, 3: b, 7: d}
        assert {r.text for r in found if r.doc_id is None} <= {c, c + " tail"}
        assert all(r.th == "x" for r in found)
    assert S.keep_one(docs.limit(0), similarity=0.8).collect() == []
