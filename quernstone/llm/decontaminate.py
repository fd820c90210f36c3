"""Benchmark decontamination with a generalised suffix automaton over the normalised words of the test items.

Training words are streamed through the automaton, which tracks the longest suffix that occurs in some item. Wherever
that length reaches the window (8 words), or a whole shorter item ends, the words it covers are hit. Words that no item
has are found first, for a whole document at once; only runs of known words that could hold a window are streamed.
"""

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow, slices

WINDOW = 8
BLOCK_CHARS = 2_000_000
MAX_COVERAGE = 0.5
CONTAMINATED_ITEMS = 2

# Word characters are 0-9, a-z and all beyond ASCII; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of every window and of every short item."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, sequence in known:
            last = 0
            for token in sequence:
                last = self._extend(last, token)
        self.shortest = min((min(window, len(s)) for _, s in known), default=window)
        self.window_items: dict[int, set] = {}
        self.short_items: dict[int, list] = {}
        for item, sequence in known:
            for _, state, length in self.stream(sequence):
                if length >= window:
                    self.window_items.setdefault(state, set()).add(item)
            if len(sequence) < window:
                self.short_items.setdefault(self._suffix(state, len(sequence)), []).append((len(sequence), item))
        self.window_items = {state: frozenset(items) for state, items in self.window_items.items()}
        # the nearest state on the way of suffix links at which a short item ends
        self.short_from = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short_from[state] = state if state in self.short_items else self.short_from[self.link[state]]

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.link) - 1

    def _clone_for(self, p: int, token: int) -> int:
        """The state for `p` followed by token, split off from a longer one if need be."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._clone_for(last, token)
        current = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = current
            p = self.link[p]
        if p >= 0:
            self.link[current] = self._clone_for(p, token)
        return current

    def _suffix(self, state: int, length: int) -> int:
        """The state of the suffix of that many words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, sequence: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """For each position: the state and the length of the longest suffix that occurs in an item, as far as the
        window needs it: a longer one is cut to the window's words, so that one step up the links is enough and no
        position climbs the chain of a long match."""
        following, link, lengths, window = self.next, self.link, self.length, self.window
        state = length = 0
        for at, token in enumerate(sequence):
            while state and token not in following[state]:
                state = link[state]
                length = lengths[state]
            if token in following[state]:
                state = following[state][token]
                length += 1
                if length > window:
                    length = window
                    while lengths[link[state]] >= window:
                        state = link[state]
            yield at, state, length

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items that have a window there."""
        hit, found, passed = np.zeros(len(words) + 1, np.int32), set(), set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long_enough = ends - starts >= self.shortest
        for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            for at, state, length in self.stream(ids[start:end].tolist()):
                if length >= self.window:
                    if state not in passed:
                        passed.add(state)
                        found |= self.window_items[state]
                    hit[start + at + 1 - self.window] += 1
                    hit[start + at + 1] -= 1
                short = self.short_from[state]
                while short > 0:
                    for size, item in self.short_items[short]:
                        if size <= length:
                            found.add(item)
                            hit[start + at + 1 - size] += 1
                            hit[start + at + 1] -= 1
                    short = self.short_from[self.link[short]]
        return np.cumsum(hit[:-1]) > 0, found


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> list[list]:
    """The items with their words, in blocks of about `chars` characters each, so that each automaton has a bounded size."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // chars))
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
        yield [(r.item, words_of(r.text.encode())) for r in part.toLocalIterator()]


_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("rest", T.StringType()),
]


def _scan(shared, cut: bool):
    """One pass over documents: adds the hit word spans and items of one block to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in slices(batches, "text"):
            n_words, starts, ends, items, rest = [], [], [], [], []
            for text, old_starts, old_ends, old_items in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends", "items")), strict=True):
                words = words_of((text or "").encode())
                hit, found = automaton.hits(words)
                for a, b in zip(old_starts or (), old_ends or (), strict=True):
                    hit[a:b] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                n_words.append(len(words))
                starts.append(edges[::2].tolist())
                ends.append(edges[1::2].tolist())
                items.append(sorted({x for x in found if x is not None}.union(old_items or ())))
                rest.append(cut_spans(text, starts[-1], ends[-1]) if cut and starts[-1] else None)
            new = {"rest": pa.array(rest, pa.string()), "n_words": pa.array(n_words, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return run


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, cut: bool = False) -> DataFrame:
    """row (all columns of docs), text, n_words, starts, ends, items, rest: one pass, no shuffle, for each block of
    items. With cut, rest is the text without the spans, null where there are none."""
    spark = docs.sparkSession
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{text}`").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        *[F.array().cast(f.dataType).alias(f.name) for f in _FOUND[1:-1]],
        F.lit(None).cast("string").alias("rest"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema.fields])
    for block in item_blocks(benchmark):
        frame = map_arrow(frame, _scan(spark.sparkContext.broadcast(SuffixAutomaton(block, window)), cut), schema)
    return frame


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, into: str = "leak") -> DataFrame:
    """Adds to docs, as the struct column `into`: n_words, the hit spans (starts, ends, in words), and the items found.

    Defined cases: null texts and items have no words; an item of fewer words than the window is one window; an item
    without words never matches; repeated item ids count once, and items without an id mark words but are not listed.
    a text may be very long or repeat one word; an empty table gives an empty result. docs keeps its rows, columns and
    repeated rows, but a column named like `into` is replaced.
    """
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != into]
    return scanned(docs, benchmark, text, window).select(*kept, F.struct(*[f.name for f in _FOUND[:-1]]).alias(into))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate(F.zip_with("leak.ends", "leak.starts", lambda b, a: b - a), F.lit(0), lambda a, x: a + x)
    n_items = F.size("leak.items").cast("long")
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"),
        (n_items >= CONTAMINATED_ITEMS).alias("contaminated"),
    )


def cut_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the characters from the first to the last word of each span."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, last = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE, max_items: int = CONTAMINATED_ITEMS) -> DataFrame:
    """docs without leaked words: spans of a window or more are cut out of the text; a document goes if hit words make
    up more than max_coverage of it or max_items items or more were found.

    Defined cases: documents without hits, with a null or an empty text stay as they are; repeated rows are treated
    alike; cases of items are those of find_contamination(); all columns stay, whatever their names."""
    found = scanned(docs, benchmark, text, cut=True)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0), lambda a, x: a + x)
    stay = found.where((F.size("items") < max_items) & (hit <= F.lit(max_coverage) * F.col("n_words")))
    return stay.select(*[(F.coalesce("rest", "text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(8, len(w)) AS k FROM b WHERE len(w) > 0))),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
m AS (SELECT s.doc_id, s.i, s.k, t.item_id FROM s JOIN t ON s.win = t.win AND s.k = t.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(f.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
"""
