"""Training-order materialisation of token ids.

Rows are dealt into buckets by a hash of key and text and ordered inside them, so that what is packed depends on the
rows alone and not on how the input was split. Texts of a bucket are encoded, joined with a separator id after each and
cut into sequences of a fixed length, which are written once. Sequence counts by bucket give every sequence a dense
global number; a keyed Feistel permutation with cycle-walking maps the number to a slot, its place in training order,
without any shuffled list; the partition of a sequence is its range of slots, one shard, known from the slot itself.
Every sequence has the same stride, so slot s lies at a known byte of a known shard and a reader can go on from any slot.
"""
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import _freeing, dropped, map_arrow, shared_folder, slices, written

VOCABULARY, SEPARATOR = "byte_bpe_50k.tiktoken", 50256
LENGTH, PER_SHARD, KEY, ROUNDS = 2048, 4096, 0x5EED, 6
DTYPE = np.dtype("<u2")
#: Bytes of text in a bucket, buckets at most, and rounds in which shards are written: a round's share of the sequences
#: is what a shuffle holds at a time.
BUCKET_BYTES, BUCKETS, PASSES = 16 << 20, 20_000, 2
#: The library's own splitting dies on much longer runs of white space.
_LONG_SPACE = re.compile(r"\s{20000}")


@lru_cache(maxsize=2)
def _encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, name: str = VOCABULARY) -> list[int]:
    """Ids of a text of any length."""
    encoding = _encoding(name)
    if len(text) < 20_000 or not _LONG_SPACE.search(text):
        return encoding.encode_ordinary(text)
    import public_tokenizers

    return [i for piece in regex.finditer(public_tokenizers.PATTERN, text) for i in encoding._encode_single_piece(piece[0].encode())]


class Packer:
    """Cuts a stream of token ids into sequences, with the rows that each sequence takes ids from."""

    def __init__(self, length: int):
        self.length, self.ids, self.starts, self.keys = length, np.empty(0, DTYPE), np.empty(0, np.int64), None

    def add(self, ids: list[np.ndarray], keys: pa.Array) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.keys = keys if self.keys is None else pa.concat_arrays([self.keys, keys])
        self.ids = np.concatenate((self.ids, *ids))

    def take(self, all_of_it: bool = False) -> tuple[list[bytes], list[int], pa.ListArray] | None:
        """Whole sequences, or at the end also the last one, filled up with separators."""
        count, rest = divmod(len(self.ids), self.length)
        count += all_of_it and rest > 0
        if not count:
            return None
        used = min(count * self.length, len(self.ids))
        padded = np.full(count * self.length, SEPARATOR, DTYPE)
        padded[:used] = self.ids[:used]
        edges = np.arange(count) * self.length
        first = np.searchsorted(self.starts, edges, side="right") - 1
        last = np.searchsorted(self.starts, np.minimum(edges + self.length, used), side="left")
        sizes = last - first
        flat = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), self.keys.take(pa.array(flat)))
        tokens = [padded[at : at + self.length].tobytes() for at in edges.tolist()]
        lengths = np.minimum(self.length, used - edges).tolist()
        self.ids = self.ids[used:]
        over = np.searchsorted(self.starts, used, side="right") - 1 if len(self.ids) else len(self.starts)
        self.starts, self.keys = np.maximum(self.starts[over:] - used, 0), self.keys.slice(over)
        return tokens, lengths, lists


def _pack(name: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, nth = Packer(length), TaskContext.get().partitionId(), 0

        def out(found):
            nonlocal nth
            tokens, lengths, lists = found
            n = len(tokens)
            numbers = pa.array(np.arange(nth, nth + n))
            nth += n
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), numbers, pa.array(lengths, pa.int32()), lists, pa.array(tokens, pa.binary())], names=["part", "nth", "n_tokens", "doc_ids", "tokens"])

        for batch in slices(batches, "text"):
            packer.add([np.array([*token_ids(t or "", name), SEPARATOR], DTYPE) for t in batch.column("text").to_pylist()], batch.column("id"))
            if found := packer.take():
                yield out(found)
        if found := packer.take(all_of_it=True):
            yield out(found)

    return run


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permuted(numbers: np.ndarray, size: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(size): a Feistel network over the next even power of two, walked until inside."""
    half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    x = np.asarray(numbers, np.uint64).copy()
    walk = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(walk):
            left, right = x[walk] >> half, x[walk] & mask
            for k in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left, k) & mask), left
                else:
                    left, right = right, left ^ (_mix(right, k) & mask)
            x[walk] = (left << half) | right
            walk = walk[x[walk] >= np.uint64(size)]
    return x.astype(np.int64)


def _placed(docs: DataFrame, key: str, text: str, length: int, per_shard: int, seed: int, vocabulary: str, scratch: list | None = None) -> tuple[DataFrame, int]:
    """All sequences with their slots and shards, and how many there are."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(1, -(-size // BUCKET_BYTES)), BUCKETS)  # by the rows, not by the machines
    dealt = rows.withColumn("h", F.xxhash64("id", "text")).repartition(buckets, "h").sortWithinPartitions("h", "id", "text").drop("h")
    packed = written(map_arrow(dealt, _pack(vocabulary, length), f"part int, nth long, n_tokens int, doc_ids array<{kind}>, tokens binary"), "sequences", scratch)
    counts = sorted((r.part, r.n) for r in packed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # BUCKETS rows at most
    total = sum(n for _, n in counts)
    begins = np.cumsum([0, *[n for _, n in counts]])[:-1].tolist()
    offsets = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, begins, strict=True)], "part int, begin long")

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), total, seed))

    placed = packed.join(F.broadcast(offsets), "part").withColumn("slot", slot(F.col("begin") + F.col("nth")))
    placed = placed.withColumn("shard", F.expr(f"slot div {per_shard}"))
    return placed.select("slot", "shard", ((F.col("slot") % per_shard) * (length * DTYPE.itemsize)).alias("byte_offset"), "n_tokens", "doc_ids", "tokens"), total


def _ordered(placed: DataFrame, first: int, end: int) -> DataFrame:
    """One partition for each of the shards, in slot order."""
    return placed.repartitionById(max(1, end - first), (F.col("shard") - first).cast("int")).sortWithinPartitions("slot")


def materialise(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """All sequences in training order: slot, shard, byte_offset, n_tokens, doc_ids, tokens (unsigned 16-bit ids).

    Each text gives its ids and one separator; a bucket's last sequence is filled up with separators, and n_tokens says
    how many ids are its own. Slots are dense from 0. Defined cases: a null or empty text gives its separator only; a
    text may have any length, in one run or many; repeated rows are packed again, next to each other; null keys stay
    null in doc_ids; an empty table gives no sequence; other columns are not read. The same rows and key give the same
    slots, however the input is split; a lost task packs the same sequences again.
    """
    placed, total = _placed(docs, key, text, length, per_shard, seed, vocabulary)
    return _ordered(placed, 0, -(-total // per_shard))


def _folder(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"shards are files of fixed stride and need a mounted folder, not {url.scheme}://")
    return url.path


def write_shards(sequences: DataFrame, folder: str) -> DataFrame:
    """Write the rows of materialise() as shard files in a folder that all machines mount; returns shard, n, sha256.

    A shard is written under a name of its attempt and renamed when whole, so a lost or repeated task leaves no half
    file and writes the same bytes again.
    """
    place = _folder(folder)
    os.makedirs(place, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, now, file, done = TaskContext.get().taskAttemptId(), None, None, []

        def close():
            file.close()
            os.replace(file.name, f"{place}/shard-{now:08d}.bin")
            done.append((now, n, digest.hexdigest()))

        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if shard != now:
                    if file:
                        close()
                    now, n, digest = shard, 0, hashlib.sha256()
                    file = open(f"{place}/.shard-{shard:08d}.{attempt}", "wb")  # noqa: SIM115
                file.write(tokens)
                digest.update(tokens)
                n += 1
        if file:
            close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([d[0] for d in done], pa.int64()), "n": pa.array([d[1] for d in done], pa.int64()), "sha256": pa.array([d[2] for d in done], pa.string())})

    return map_arrow(sequences.select("shard", "tokens"), run, "shard long, n long, sha256 string")


def finish(manifests: list[DataFrame], folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = KEY) -> dict:
    """Run write_shards, one frame after another, and leave manifest.json: one row for each shard, by which a reader
    checks and resumes."""
    shards = []
    for manifest in manifests:
        with _freeing(manifest.sparkSession):
            # a plan made here: one made before does not know that its shuffle files are to go
            shards += map(tuple, manifest.select("*").collect())  # one row for each file
    shards.sort()
    about = {"length": length, "per_shard": per_shard, "dtype": DTYPE.str, "seed": seed, "total": sum(s[1] for s in shards), "shards": shards}
    path = f"{_folder(folder)}/manifest.json"
    os.makedirs(_folder(folder), exist_ok=True)
    with open(path + ".part", "w") as out:
        json.dump(about, out)
    os.replace(path + ".part", path)
    return about


def _read(place: str, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            tokens = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("byte_offset").to_pylist(), strict=True):
                if shard != now:
                    if file:
                        file.close()
                    now, file = shard, open(f"{place}/shard-{shard:08d}.bin", "rb")  # noqa: SIM115
                file.seek(offset)
                tokens.append(file.read(stride))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], names=[*batch.schema.names, "tokens"])
        if file:
            file.close()

    return run


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = KEY, vocabulary: str = VOCABULARY, folder: str | None = None, passes: int = PASSES) -> DataFrame:
    """The rows of materialise(), their tokens as read back from the shards that are written to `folder` with a
    manifest first: a new one in the shared folder unless given. The folder must be mounted by all machines. Shards are
    written in `passes` rounds of consecutive shards, so that a shuffle holds a part of the sequences only."""
    spark, scratch = docs.sparkSession, []
    folder = folder or f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    placed, total = _placed(docs, key, text, length, per_shard, seed, vocabulary, scratch)
    edges = sorted({round(i * -(-total // per_shard) / passes) for i in range(passes + 1)})
    rounds = [_ordered(placed.where(F.col("shard").between(a, b - 1)), a, b) for a, b in zip(edges, edges[1:], strict=False)]
    finish([write_shards(r, folder) for r in rounds], folder, length, per_shard, seed)
    rows = written(placed.drop("tokens"), "places")
    dropped(spark, scratch)
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return map_arrow(_ordered(rows, 0, -(-total // per_shard)), _read(_folder(folder), length * DTYPE.itemsize), f"{kinds}, tokens binary")


def read_slots(folder: str, start: int = 0) -> Iterator[np.ndarray]:
    """Sequences from slot `start` on, in order, by seeking to its place."""
    place = _folder(folder)
    with open(f"{place}/manifest.json") as lines:
        about = json.load(lines)
    stride = about["length"] * np.dtype(about["dtype"]).itemsize
    for shard in range(start // about["per_shard"], -(-about["total"] // about["per_shard"])):
        with open(f"{place}/shard-{shard:08d}.bin", "rb") as file:
            file.seek((start - shard * about["per_shard"]) * stride if start > shard * about["per_shard"] else 0)
            while chunk := file.read(stride):
                yield np.frombuffer(chunk, about["dtype"])
