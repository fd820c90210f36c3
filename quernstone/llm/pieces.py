"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text, with spaces escaped and one put before it, falls apart into words, because no piece of the vocabulary has an
escaped space after another character (checked when the model is loaded). Words that were not met before are encoded
together: their characters lie in one flat array of symbols, each round finds the best pair of every word by a
segmented minimum over pair ranks, merges it at its leftmost places in all words at once, compacts the arrays and drops
the words in which no pair is left. Encoded words are kept as bytes, so that a text is a join over its words.

A word merges one pair a round, as the library's algorithm does, at all its places if no merge that the new symbol
could take part in has a better rank than its own, and else at the leftmost place only. An unbroken run of more than
LONG_WORD characters would need too many rounds, each over all of it: there the pairs wait in a heap by rank and place,
which takes n log n steps and gives the same symbols.
"""

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import RELEASES, map_arrow, slices

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
CACHE_WORDS, LONG_WORD = 200_000, 2000
_BATCH_SYMBOLS = 1 << 18
_NONE = np.int32(2**31 - 1)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def model_path(name: str = MODEL) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Tables of one model: characters, ranked pairs, the bytes that every id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        self.bos, self.eos = library.bos_id(), library.eos_id()
        pieces = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        ids = {pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece joins two words: words cannot be encoded apart")
        self.byte_ids = np.zeros(256, np.uint32)
        self.values: list[bytes] = [b""] * size
        for i in range(size):
            if library.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.byte_ids[value] = i
                self.values[i] = bytes([value])
        for i in plain:
            self.values[i] = pieces[i].replace(SPACE, " ").encode()
        # symbols: ids below size are pieces, characters outside the vocabulary follow as they are met
        self.size = size
        self.of_code = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_code[ord(p)] = i
        # pieces of one score share a rank: of their places the leftmost goes first
        rank = np.full(size, _NONE, np.int32)
        rank[plain] = np.unique([-library.get_score(i) for i in plain], return_inverse=True)[1]
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left * size + right
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_made, self.rank = keys[by_key], made[by_key], rank
        # symbols that can take part in a merge that goes before their own
        best = np.full(size, _NONE, np.int32)
        np.minimum.at(best, left, rank[made])
        np.minimum.at(best, right, rank[made])
        self.careful = best <= rank
        self.by_pair: dict[int, int] | None = None
        self._slots()

    def _slots(self) -> None:
        """A hash table of the pairs for vectorised look-ups: rows of a few slots, as many as the fullest row needs."""
        self.bits = int(len(self.pair_keys)).bit_length() + 2
        row = self._row(self.pair_keys)
        order = np.argsort(row, kind="stable")
        sorted_rows = row[order]
        starts = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        depth = int(place.max()) + 1
        self.slot_keys = np.full((depth, 1 << self.bits), -1, np.int64)
        self.slot_made = np.full((depth, 1 << self.bits), -1, np.int32)
        self.slot_keys[place, sorted_rows] = self.pair_keys[order]
        self.slot_made[place, sorted_rows] = self.pair_made[order]

    def _row(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each neighbouring pair makes, -1 where the vocabulary has none."""
        keys = np.where((left < self.size) & (right < self.size), left * self.size + right, -2)
        row = self._row(keys)
        first = self.slot_keys[0][row]
        out = np.where(first == keys, self.slot_made[0][row], -1)
        rest = np.flatnonzero((first != keys) & (first >= 0) & (keys >= 0))
        for slot_keys, slot_made in zip(self.slot_keys[1:], self.slot_made[1:], strict=True):
            at = row[rest]
            same = slot_keys[at] == keys[rest]
            out[rest[same]] = slot_made[at[same]]
            rest = rest[~same & (slot_keys[at] >= 0)]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words that lie one after another; returns their symbols and lengths at the end."""
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        index = np.arange(len(lengths))
        word = np.repeat(index, lengths)
        piece = np.full(len(symbols), -1, np.int32)
        near = np.flatnonzero(word[:-1] == word[1:])
        piece[near] = self.pairs(symbols[near], symbols[near + 1])
        while len(lengths):
            rank = np.where(piece >= 0, self.rank[piece], _NONE)
            best = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            over = best == _NONE
            if over.any():
                done = over[word]
                results.append((index[over], lengths[over], symbols[done]))
                keep = ~done
                symbols, piece, rank, index, lengths, best = symbols[keep], piece[keep], rank[keep], index[~over], lengths[~over], best[~over]
                if not len(lengths):
                    break
                word = np.repeat(np.arange(len(lengths)), lengths)
            at = np.flatnonzero(rank == best[word])
            owner = word[at]
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            made = piece[at]
            # places one after another overlap (as in aaaa): of each such run every second one counts, from the left
            run = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | first[1:])))
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            take = (nth % 2 == 0) & (first | ~self.careful[made])
            at, owner, made = at[take], owner[take], made[take]
            symbols[at] = made
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, piece, word = symbols[keep], piece[keep], word[keep]
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            # only pairs beside a new symbol have changed
            at = at - np.arange(len(at))
            piece[at] = -1
            near = np.concatenate((at, at[at > 0] - 1))
            near = near[near + 1 < len(symbols)]
            near = near[word[near] == word[near + 1]]
            piece[near] = self.pairs(symbols[near], symbols[near + 1])
        if not results:
            return symbols, lengths
        order = np.concatenate([r[0] for r in results])
        sizes = np.concatenate([r[1] for r in results])
        flat = np.concatenate([r[2] for r in results])
        back = np.argsort(order)
        begins = (np.cumsum(sizes) - sizes)[back]
        sizes = sizes[back]
        offset = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        return flat[offset + np.arange(len(flat))], sizes

    def merge_all(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of the words, merge_long() of those of more than LONG_WORD characters."""
        long = np.flatnonzero(sizes > LONG_WORD)
        if not len(long):
            return self.merge(symbols, sizes)
        begins = np.cumsum(sizes) - sizes
        at_long = np.repeat(sizes > LONG_WORD, sizes)
        rest = sizes <= LONG_WORD
        flat, lengths = self.merge(symbols[~at_long], sizes[rest]) if rest.any() else (symbols[:0], sizes[:0])
        parts: list[np.ndarray] = [None] * len(sizes)
        for i, part in zip(np.flatnonzero(rest).tolist(), np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else [], strict=True):
            parts[i] = part
        for i in long.tolist():
            parts[i] = self.merge_long(symbols[begins[i] : begins[i] + sizes[i]])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word: a heap of pairs over a linked list of symbols."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.pair_keys.tolist(), self.pair_made.tolist(), strict=True))
        made_by, size, n = self.by_pair, self.size, len(symbols)
        left, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        made = self.pairs(symbols[:-1], symbols[1:]).tolist() + [-1]
        ranks, bits = self.rank.tolist(), n.bit_length()
        low = (1 << bits) - 1
        heap = [ranks[m] << bits | i for i, m in enumerate(made) if m >= 0]
        heapq.heapify(heap)

        def look(i: int) -> None:
            j = after[i]
            made[i] = made_by.get(left[i] * size + left[j], -1) if j < n and left[i] < size and left[j] < size else -1
            if made[i] >= 0:
                heapq.heappush(heap, ranks[made[i]] << bits | i)

        while heap:
            top = heapq.heappop(heap)
            i = top & low
            if made[i] < 0 or ranks[made[i]] != top >> bits:
                continue  # what it was pushed for is gone
            j = after[i]
            left[i], left[j], made[j] = made[i], -1, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in left if x >= 0], np.int64)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = self.of_code[codes]
        unknown = np.flatnonzero(symbols < 0)
        strange, which = np.unique(codes[unknown], return_inverse=True)
        symbols[unknown] = self.size + which
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, sizes = self.merge_all(symbols, sizes)
        if len(strange):  # characters outside the vocabulary become their bytes
            as_bytes = [self.byte_ids[list(chr(c).encode())] for c in strange.tolist()]
            counts = np.ones(len(symbols), np.int64)
            out = symbols >= self.size
            counts[out] = [len(as_bytes[s - self.size]) for s in symbols[out].tolist()]
            flat = np.repeat(symbols, counts)
            flat[np.repeat(out, counts)] = np.concatenate([as_bytes[s - self.size] for s in symbols[out].tolist()]) if out.any() else []
            ends = np.cumsum(counts)[np.cumsum(sizes) - 1]
            symbols, sizes = flat, np.diff(np.concatenate(([0], ends)))
        raw = symbols.astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes texts, keeping the ids of up to CACHE_WORDS words it has met."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.model, self.cache, self.cache_words = _model(path), {}, cache_words
        self.bos, self.eos = (int(x).to_bytes(4, "little") for x in (self.model.bos, self.model.eos))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids with begin and end as little-endian unsigned 32-bit numbers; null counts as empty."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        fresh = list(set().union(*split).difference(cache))
        if len(cache) + len(fresh) > self.cache_words:
            cache.clear()
            fresh = list(set().union(*split))
        start = symbols = 0
        for i, word in enumerate(fresh):
            symbols += len(word)
            if symbols >= _BATCH_SYMBOLS or i == len(fresh) - 1:
                part = fresh[start : i + 1]
                cache.update(zip(part, self.model.encode_words(part), strict=True))
                start, symbols = i + 1, 0
        get = cache.__getitem__
        return [b"".join((self.bos, *map(get, words), self.eos)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids as UTF-8: values joined, control ids skipped, without the space put before the text."""
        values = self.model.values
        raw = b"".join(map(values.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:] if raw[:1] == b" " else raw


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each task, so that words stay known from batch to batch."""
    return Encoder(path)


RELEASES.append(encoder.cache_clear)


def _encoded(name: str, text: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path(name))
        for batch in slices(batches, "text"):
            ids = coder.encode(batch.column("text").to_pylist())
            decoded = [coder.decode(x) for x in ids]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digest:
                out = [n, pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                out = [n, pa.array(ids, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in decoded], pa.string())]
                names = ["n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *out], names=["row", *names])

    return run


def _apply(docs: DataFrame, text: str, name: str, digest: bool) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if digest or c != text] or [F.lit(0).alias("none")]
    frame = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = frame.schema["row"].dataType.simpleString()
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids binary, decoded string"
    return map_arrow(frame, _encoded(name, text, digest), f"row {kind}, {columns}")


def encode_decode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs without its text, followed by n_tokens, ids (little-endian unsigned 32-bit, with begin and end) and decoded.

    model names a public tokenizer file that every machine has. Defined cases: null and empty texts give the begin and
    end ids only and decode to an empty text; characters outside the vocabulary become byte pieces; one row for each
    input row; columns of docs with the names of results are replaced by them. No shuffle.
    """
    made = ("n_tokens", "ids", "decoded")
    found = _apply(docs.drop(*[c for c in made if c != text]), text, model, digest=False)
    return found.select("row.*", *made) if len(docs.columns) > 1 else found.select(*made)


def piece_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _apply(docs.select("doc_id", "text"), "text", MODEL, digest=True).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
