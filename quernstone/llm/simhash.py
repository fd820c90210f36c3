"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints of 64 bits link where they differ in `radius` bits at most. The search is exact: every bit position gets
a nonzero vector of radius + 1 bits, and for every nonzero vector v there is a table whose mask holds the positions of
odd inner product with v. The vectors of up to `radius` differing positions never span the whole space, so some v is
orthogonal to them all: in its table both fingerprints look alike and meet in one bucket.

Only distinct fingerprints are searched, so copies cost one row. Buckets of one are dropped; a bucket of more than
`chunk` fingerprints is dealt into chunks and every pair of chunks is a block of its own, so that a block is bounded
and no pair is lost. A block returns a spanning forest of its links, not its pairs. Components are then found by
alternating star operations on the links, with a reliable checkpoint in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import attached, checkpointed, map_arrow, salt, salts_seen, slices, written

BITS, RADIUS, SHINGLE, SEED, CHUNK = 64, 4, 4, 42, 2048
_BUFFER = 1 << 16
SAMPLE, COMMON, SENT = 16, 100_000, 1_000_000

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles in order; fewer words than a shingle count as one shingle."""
    words = text.lower().split()  # on bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    m = len(words) - shingle + 1
    if m <= 1:
        return np.array([_hash(joined)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:m].tolist()
    return np.fromiter((_hash(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, m)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 hashes of all word shingles, repeats included; 0 if there are no words."""
    return _majority(_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return run


def masks(radius: int = RADIUS) -> list[int]:
    """The bit masks of the covering tables, 2 ** (radius + 1) - 1 of them, as signed 64-bit numbers."""
    space = 2 ** (radius + 1)
    vector = [i % (space - 1) + 1 for i in range(BITS)]
    found = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, space)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def forest(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one group (groups are runs) as (member, root), one for each linked member."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(first, n))
    left = np.repeat(first + sizes, sizes) - np.arange(n)  # rows from here to the group's end
    label = np.arange(n)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    rows = np.arange(n)
    for offset in range(1, int(sizes.max(initial=1))):
        rows = rows[left[rows] > offset]
        close = np.bitwise_count(fp[rows] ^ fp[rows + offset]) <= radius
        a = rows[close]
        a = a[label[a] != label[a + offset]]
        for i in a.tolist():
            x, y = root(i), root(i + offset)
            if x != y:
                label[max(x, y)] = min(x, y)
        if len(a):
            while not np.array_equal(up := label[label], label):
                label = up
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _links(radius: int):
    keys = ("v", "k", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0

        def close(parts, whole):
            rows = {c: np.concatenate([p[c] for p in parts]) for c in (*keys, "fp")}
            changes = np.zeros(len(rows["fp"]), bool)
            for c in keys:
                changes[1:] |= rows[c][1:] != rows[c][:-1]
            cut = len(changes) if whole else (np.flatnonzero(changes)[-1] if changes.any() else 0)
            if not cut:
                return None, rows
            a, b = forest(rows["fp"][:cut].view(np.uint64), np.cumsum(changes[:cut]), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), {c: x[cut:] for c, x in rows.items()}

        for batch in batches:
            kept.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fp")})
            count += batch.num_rows
            if count >= _BUFFER:
                out, rest = close(kept, False)
                kept, count = [rest], len(rest["fp"])
                if out is not None:
                    yield out
        if count:
            yield close(kept, True)[0]

    return run


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Rows (a, b): links enough to connect all distinct fingerprints `fp` that differ in at most `radius` bits."""
    spark = prints.sparkSession
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for v, m in enumerate(masks(radius))])
    # as many tasks as a shuffle has, however few bytes the fingerprints are
    spread = prints.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = spread.select("fp", F.explode(tables).alias("t")).select("fp", "t.v", "t.k")
    large = written(keyed.groupBy("v", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("v", "k", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("m")), "large")
    small = large.count() <= SENT  # 24 bytes each; else both sides are shuffled
    rows = keyed.join(F.broadcast(large) if small else large, ["v", "k"], "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    blocks = rows.select("v", "k", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    blocks = blocks.select("v", "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    placed = blocks.repartition("v", "k", "i", "j").sortWithinPartitions("v", "k", "i", "j", "fp")
    return map_arrow(placed, _links(radius), "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) by alternating large-star and small-star steps: rows (a, b), b the least of a's
    component, without the row of b itself."""
    frame = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = frame.union(frame.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        frame = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
        seen = frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return frame
        mark = seen


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, fp (signed) and component_id, the least key of the rows reachable over links, for each row of docs.

    Defined cases: a null or blank text has the fingerprint 0 and links like any other; fewer words than a shingle
    count as one shingle; rows with a null key get the least non-null key of their component, or null if it has none;
    repeated rows each get a row; texts of any length count in full. An empty table gives an empty result. Other columns
    are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = written(map_arrow(rows, _fingerprints(shingle), f"id {dict(rows.dtypes)['id']}, fp long"), "prints").withColumn("salt", salt("id"))
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first"), salts_seen(F.col("salt")).alias("salts")), "distinct")
    roots = stars(links(distinct.select("fp"), radius))
    placed = distinct.join(roots, distinct.fp == roots.a, "left").select("fp", "first", "salts", F.coalesce("b", "fp").alias("root")).withColumn("salt", salt("fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), salts_seen(F.col("salt")).alias("salts"))
    named = attached(placed.withColumnRenamed("salts", "own"), least, "root").select("fp", "component_id", F.col("own").alias("salts"))
    return attached(prints, named, "fp").select("id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    found = components(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _need(a, b, similarity: float):
    """The least overlap that gives sets of sizes a and b the asked Jaccard similarity."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The set of hashes of a text's word shingles, ascending."""
    return np.unique(_hashes(text, shingle))


def _described(shingle: int, similarity: float, common):
    """For each row its set's name and size, its fingerprint, and as many hashes (rare ones first) as two similar sets
    cannot both lack: any order that all rows share is exact, and this one keeps crowds out of most buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value
        for batch in slices(batches, "text"):
            names, sizes, prints, firsts = [], [], [], []
            for t in batch.column("text").to_pylist():
                every = _hashes((t or "").encode(), shingle)
                own = np.unique(every)
                n = len(own)
                last = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own if len(often) else np.zeros(n, bool)
                ordered = np.concatenate((own[~last], own[last]))
                names.append(_hash(own.tobytes()))
                sizes.append(n)
                prints.append(_majority(every))
                firsts.append(ordered[: n - int(np.ceil(similarity * n - 1e-9)) + 1].tobytes())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), signed(names), signed(prints), pa.array(sizes, pa.int32()), pa.array(firsts, pa.binary())], names=["id", "th", "s", "fp", "n", "first"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "first"):
        firsts = [np.frombuffer(x, np.int64) for x in batch.column("first").to_pylist()]
        counts = np.fromiter(map(len, firsts), np.int64, len(firsts))
        if not counts.sum():
            continue
        take = pa.array(np.repeat(np.arange(len(counts)), counts))
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), *[batch.column(c).take(take) for c in ("s", "c", "n")], pa.array(at, pa.int32())], names=["h", "s", "c", "n", "at"])


def _sampled(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles((t or "").encode(), shingle).view(np.int64))], names=["h"])

    return run


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that many texts hold, by a sample of one text in SAMPLE. What it misses costs time only."""
    some = rows.where(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]).select("text")
    found = map_arrow(some, _sampled(shingle), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k >= 4").orderBy(F.desc("k"), "h").limit(COMMON)
    return np.sort(np.array([r.h for r in found.collect()], np.int64).view(np.uint64))


def _candidates(similarity: float):
    """Pairs of one bucket that sizes and places in the order allow, and that are not of one component yet."""
    keys = ("h", "i", "j")

    def pairs(rows, first, last):
        s, c, n, at, side = (rows[k][first:last] for k in ("s", "c", "n", "at", "side"))
        if (c == c[0]).all():
            return
        i, j = rows["i"][first], rows["j"][first]
        others = np.arange(len(s)) if i == j else np.flatnonzero(side == j)
        for x in range(len(s)) if i == j else np.flatnonzero(side == i):
            y = others[others > x] if i == j else others
            y = y[(c[y] != c[x]) & (1 + np.minimum(n[x] - at[x], n[y] - at[y]) - 1 >= _need(n[x], n[y], similarity))]
            if len(y):
                yield np.minimum(s[x], s[y]), np.maximum(s[x], s[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*keys, "s", "c", "n", "at", "side")
        kept, count = [], 0

        def close(parts, whole):
            rows = {k: np.concatenate([p[k] for p in parts]) for k in names}
            starts = np.flatnonzero(np.concatenate(([True], np.any([rows[k][1:] != rows[k][:-1] for k in keys], axis=0))))
            ends = np.append(starts[1:], len(rows["h"]))
            cut = len(rows["h"]) if whole else starts[-1]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b <= cut and b - a > 1:
                    for low, high in pairs(rows, a, b):
                        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])
            kept[:] = [{k: x[cut:] for k, x in rows.items()}]

        for batch in batches:
            kept.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in names})
            count += batch.num_rows
            if count >= _BUFFER:
                yield from close(kept, False)
                count = len(kept[0]["h"])
        if count:
            yield from close(kept, True)

    return run


def _confirmed(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in ("x", "y"))
            good = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                good.append(len(np.intersect1d(p, q, assume_unique=True)) >= _need(len(p), len(q), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles((t or "").encode(), shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(sets, pa.binary())], names=["s", "set"])

    return run


def _freed(df: DataFrame) -> DataFrame:
    """Cut off from what made it, whose shuffle files go."""
    return written(df, "step")


def similar(docs: DataFrame, key: str, text: str, shingle: int, similarity: float, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """id, th (a hash of the text) and component for each row: components over all pairs whose sets of word shingles
    have a Jaccard similarity of `similarity` or more.

    No fingerprint distance stands for a similarity, so fingerprints only come first: links within `radius` bits, once
    confirmed on the sets, join crowds of near copies early. Then sets that share one of their first hashes, and whose
    sizes and places allow it, are compared unless they are of one component already. Two sets of that similarity
    always share one, so no pair is lost. Blank texts have the empty set and are alike.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, shingle))
    kind = dict(rows.dtypes)["id"]
    found = _freed(map_arrow(rows, _described(shingle, similarity, common), f"id {kind}, th long, s long, fp long, n int, first binary"))
    found = found.withColumn("salt", salt("id", "th"))
    sets = _freed(found.groupBy("s").agg(salts_seen(F.col("salt")).alias("salts"), F.min("th").alias("th"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("first").alias("first")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(sets.select("s", "th"), "s")
        wanted = _freed(wanted)
        small = wanted.count() <= SENT  # 16 bytes each; else both sides are shuffled
        texts = rows.select("th", "text").join(F.broadcast(wanted) if small else wanted, "th").select("s", "text")
        full = _freed(map_arrow(texts, _sets(shingle), "s long, set binary").dropDuplicates(["s"]))
        both = pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")
        return _freed(map_arrow(both, _confirmed(similarity), "a long, b long"))

    distinct = sets.groupBy("fp").agg(F.min("s").alias("s"))
    named = distinct.select(F.col("fp").alias("a"), F.col("s").alias("sa")), distinct.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    near = links(distinct.select("fp"), radius).join(named[0], "a").join(named[1], "b").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    early = confirmed(_freed(near))
    roots = stars(early)
    rest = sets.join(roots.toDF("s", "c"), "s", "left").select("s", F.coalesce("c", "s").alias("c"), "n", "first")
    spread = map_arrow(rest, _spread, "h long, s long, c long, n int, at int")
    # a bucket of one component has nothing to settle, and most hold one set only
    large = spread.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    kept = spread.join(large.select("h", F.ceil(F.col("k") / F.lit(chunk)).cast("int").alias("m")), "h").withColumn("side", F.pmod(F.xxhash64("s"), F.col("m")).cast("int"))
    dealt = kept.select("h", "s", "c", "n", "at", "side", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    dealt = dealt.select("h", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "s", "c", "n", "at", "side")
    placed = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "s")
    late = confirmed(_freed(map_arrow(placed, _candidates(similarity), "a long, b long").distinct()))
    roots = stars(early.union(late))
    named = sets.select("s", "salts").join(roots.toDF("s", "c"), "s", "left").select("s", "salts", F.coalesce("c", "s").alias("component"))
    return attached(found.select("id", "th", "s", "salt"), named, "s").select("id", "th", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """One row of each component, all columns of docs: that of the least key, a null one only where there is no other;
    among rows of that key the one with the least hash of its text; of rows alike in both, one.

    Components are those of linked fingerprints, or with `similarity` those of similar()."""
    own, th = F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))
    named = docs.select(F.struct(own.isNull().alias("none"), own.alias("id"), th.alias("th")).alias("row"), F.col(f"`{text}`").alias("text"))
    if similarity is None:
        found = components(named, "row", "text", shingle, radius).withColumnRenamed("component_id", "component")
    else:
        found = similar(named, "row", "text", shingle, similarity, radius)
    counted = found.groupBy("component", "id").agg(F.count(F.lit(1)).alias("k"))
    chosen = _freed(counted.groupBy("component").agg(F.min(F.struct("id", "k")).alias("w")).select("w.id.id", "w.id.th", "w.k"))
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    same = rows[names[key]].eqNullSafe(chosen["id"]) & (F.xxhash64(rows[names[text]]) == chosen["th"])
    single = rows.join(chosen.where("k = 1"), same, "left_semi")
    alike = rows.join(chosen.where("k > 1"), same).groupBy("id", "th").agg(F.first(F.struct(*names.values())).alias("row"))
    return single.unionByName(alike.select("row.*")).toDF(*docs.columns)
