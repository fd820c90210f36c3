"""Each stage, and all of them in a row, against plain Python on a small fixture."""

import random

import numpy as np
import sentencepiece

import corpus_pipeline
from quernstone.llm import pieces, toxicity
from quernstone.llm.decontaminate import cut_spans
from quernstone.llm.features import training_rows
from tests.llm.test_decontaminate import split
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute as brute_components, plain_fingerprint

WORDS = [a + b for a in ("ber", "tion", "the", "an", "or", "ch", "ul", "ma") for b in ("a", "en", "il", "os", "ud", "é", "st", "ne")]


def fixture():
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    items = [(i, line(14)) for i in range(6)]
    shared, rows, labels = line(12), [], []
    for i in range(160):
        toxic = rng.random() < 0.3
        lines = [line(rng.randint(6, 25)) for _ in range(rng.randint(1, 5))]
        if toxic:
            lines[0] = " ".join("zzgrk" + rng.choice(WORDS) if k % 4 == 0 else w for k, w in enumerate(lines[0].split()))
        if i % 5 == 0:
            lines.append(shared)
        if i % 7 == 0:
            lines.append(line(4) + " " + rng.choice(items)[1] + ". " + line(5))
        if i % 31 == 0:
            lines = [items[0][1], items[1][1]]
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[3][1]), (201, rows[8][1] + " tail"), (202, rows[11][1].replace(" ", "  ")), (203, None), (204, ""), (205, "x")]
    return [(i, t, "en", "s" if i % 3 else "hot", len(t) if t is not None else None) for i, t in rows], items, labels


def near(rows, size):
    prints = [(r[0], plain_fingerprint(r[1], size)) for r in rows]
    least = brute_components(prints)
    return [r for r, c in zip(rows, least, strict=True) if r[0] == c]


def leaks(rows, items):
    out = []
    for row in rows:
        words, hit, found = split(row[1]), set(), set()
        for item, text in items:
            t = split(text)
            for i in range(len(t) - 7):
                for j in range(len(words) - 7):
                    if words[j : j + 8] == t[i : i + 8]:
                        hit.update(range(j, j + 8))
                        found.add(item)
        if len(found) >= 2 or len(hit) > 0.5 * len(words):
            continue
        spans = sorted(hit)
        starts = [k for k in spans if k - 1 not in hit]
        ends = [k + 1 for k in spans if k + 1 not in hit]
        text = cut_spans(row[1], starts, ends) if hit else row[1]
        out.append((row[0], text, *row[2:4], len(text) if text is not None else row[4]))
    return out


def test_stages_and_run_equal_plain_python(spark, tmp_path):
    rows, items, labels = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = toxicity.fit(training_rows(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic"))
    scores = net.scores([(r[1] or "").encode() for r in rows])
    want = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & {r[0] for r in want}) <= 3 and len(want) >= 0.95 * (len(rows) - len(toxic))
    steps = [
        want,
        want := [(r[0], t, *r[2:4], len(t) if t is not None else r[4]) for r, (_, t, _, _) in zip(want, brute_lines([(r[0], r[1]) for r in want]), strict=True)],
        want := near(want, corpus_pipeline.SHINGLE),
        want := leaks(want, items),
    ]
    sizes = [len(rows), *map(len, steps)]
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] > 20
    frame = docs
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
        got = frame.collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
        frame = spark.createDataFrame(got, schema)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    ids = {r[0]: np.array(library.encode(r[1] or "", add_bos=True, add_eos=True), "<u4").tobytes() for r in want}
    for result in (corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        found = result.collect()
        assert {r.doc_id: bytes(r.ids) for r in found} == ids and len(found) == len(ids)
        assert all(r.decoded == next(w[1] or "" for w in want if w[0] == r.doc_id) for r in found)
