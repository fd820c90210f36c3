"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A text is its lower-case words. Each word enters as two learned vectors: its own, if it is in the vocabulary of the
training texts, and the mean over its hashed character n-grams, by which unseen spellings are read. Windows of 32 words,
each overlapping the next by half, run through the network; a text scores as its worst window.

Training has two steps, both on text labels alone. First the vectors are learned: a text is the attention-weighted mean
of its words on one learned direction. Then network and vectors are trained together, by back-propagation through time
on the window of each training text that scores highest at the time (at first: that holds the strongest words of the
first step), so a text-level label teaches window scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, release, slices
from .decontaminate import _FOLD
from .features import Bytes, grams, held_out, training_rows

LENGTH, STRIDE = 32, 16
GRAMS, EMBED, HIDDEN, ATTEND, SIZES = 1 << 18, 8, 8, 8, (3, 5)
#: Training texts that a word must occur in to be of the vocabulary, and how sharply the first step attends.
SEEN, SHARP = 3, 6.0
#: One window of unknown words with label 0 stands beside that many others: words that nothing is known of are no sign.
BLANK = 16
STEPS, EPOCHS, RATE, BATCH, BLOCK = 360, (3, 30), 0.01, 64, 2048
THRESHOLD = 0.5
_INPUTS = 2 * EMBED
_SPACES = np.zeros(256, bool)
_SPACES[32] = True


class Words:
    """The distinct words of some texts with their n-gram buckets, and the place of each word in each text."""

    def __init__(self, texts: list[bytes]):
        source = Bytes([t.translate(_FOLD) for t in texts])
        starts, ends, doc = source.words(_SPACES)
        self.hashes, first, self.index = np.unique(source.hashes(starts, ends), return_index=True, return_inverse=True)
        gram, self.n_grams = grams(source, starts[first], ends[first], SIZES)
        self.gram = (gram % np.uint64(GRAMS)).astype(np.int32)
        self.gram_starts = np.cumsum(self.n_grams) - self.n_grams
        self.doc_lengths = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        self.doc_starts = np.cumsum(self.doc_lengths) - self.doc_lengths

    @classmethod
    def of_many(cls, texts: list[bytes], chunk: int = 1 << 18) -> Words:
        """The same for a long list of texts, hashed a chunk of bytes at a time."""
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.flatnonzero(np.diff(ends // chunk, prepend=0))
        parts = [cls(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True) if b > a]
        all_hashes = np.concatenate([x.hashes for x in parts])
        self = cls.__new__(cls)
        self.hashes, first, back = np.unique(all_hashes, return_index=True, return_inverse=True)
        offsets = np.cumsum([0, *[len(x.hashes) for x in parts]])
        self.index = np.concatenate([back[at + x.index] for at, x in zip(offsets[:-1], parts, strict=True)]).astype(np.int32)
        n_grams, gram = np.concatenate([x.n_grams for x in parts]), np.concatenate([x.gram for x in parts])
        starts = (np.cumsum(n_grams) - n_grams)[first]
        self.n_grams = n_grams[first]
        self.gram_starts = np.cumsum(self.n_grams) - self.n_grams
        self.gram = gram[np.repeat(starts - self.gram_starts, self.n_grams) + np.arange(int(self.n_grams.sum()))]
        self.doc_lengths = np.concatenate([x.doc_lengths for x in parts])
        self.doc_starts = np.cumsum(self.doc_lengths) - self.doc_lengths
        return self

    def flat_grams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-gram buckets of some distinct words one after another, where each word's begin, and how many it has."""
        counts = self.n_grams[some]
        starts = np.cumsum(counts) - counts
        return self.gram[np.repeat(self.gram_starts[some] - starts, counts) + np.arange(int(counts.sum()))], starts, counts

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and text of every window; a text without words has none."""
        count = np.where(self.doc_lengths > 0, np.maximum(1, -(-(self.doc_lengths - LENGTH) // STRIDE) + 1), 0)
        doc = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = self.doc_starts[doc] + nth * STRIDE
        return start, np.minimum(LENGTH, self.doc_starts[doc] + self.doc_lengths[doc] - start), doc

    def rows(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Distinct-word numbers of windows, -1 after a window's end."""
        at = start[:, None] + np.arange(LENGTH)
        inside = np.arange(LENGTH) < size[:, None]
        return np.where(inside, self.index[np.minimum(at, len(self.index) - 1)], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Weights, forward pass and gradients. Gates are in the order update, reset, candidate."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = np.zeros(1, np.uint64)
        self.p = {
            "word": np.zeros((1, EMBED), np.float32),
            "gram": (0.05 * rng.normal(size=(GRAMS, EMBED))).astype(np.float32),
            "u": draw(_INPUTS, 1)[:, 0],
            "a": draw(2 * HIDDEN, ATTEND),
            "v": draw(ATTEND, 1)[:, 0],
            "o": draw(2 * HIDDEN, 1)[:, 0],
            "c": np.array([-1.0], np.float32),
        }
        for way in "fb":
            self.p |= {f"w{way}": draw(_INPUTS, 3 * HIDDEN), f"u{way}": draw(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}

    def learn_vocabulary(self, words: Words) -> None:
        """A vector for each word of enough texts; row 0 stands for all others."""
        texts = np.zeros(len(words.hashes), np.int32)
        for start, length in zip(words.doc_starts.tolist(), words.doc_lengths.tolist(), strict=True):
            texts[np.unique(words.index[start : start + length])] += 1
        self.vocabulary = np.concatenate((np.zeros(1, np.uint64), words.hashes[texts >= SEEN]))  # hashes are in order
        rng = np.random.default_rng(len(self.vocabulary))
        self.p["word"] = (0.05 * rng.normal(size=(len(self.vocabulary), EMBED))).astype(np.float32)
        self.p["word"][0] = 0  # stays so: other words are read by their n-grams alone

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of words in the vocabulary, 0 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, 0)

    def inputs(self, words: Words, some: np.ndarray | None = None) -> np.ndarray:
        """One row for each distinct word, or for some of them."""
        some = np.arange(len(words.hashes)) if some is None else some
        x = np.empty((len(some), _INPUTS), np.float32)
        if len(some):
            x[:, :EMBED] = self.p["word"][self.known(words.hashes[some])]
            flat, starts, counts = words.flat_grams(some)
            x[:, EMBED:] = np.add.reduceat(self.p["gram"][flat], starts, axis=0) / counts[:, None].astype(np.float32)
        return x

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Each distinct word's share of the gates, forward and backward; a last row of zeros stands for no word."""
        out = np.zeros((len(x) + 1, 6 * HIDDEN), np.float32)
        for k, way in enumerate("fb"):
            own = out[:-1, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
            np.matmul(x, self.p[f"w{way}"], out=own)
            own += self.p[f"b{way}"]
        return out

    def run(self, gates: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows of distinct-word numbers. keep: gets what the gradients need."""
        n, full = len(rows), bool((rows >= 0).all())
        mask = (rows >= 0).astype(np.float32)
        states = np.empty((LENGTH, n, 2 * HIDDEN), np.float32)
        for k, way in enumerate("fb"):
            u, own = self.p[f"u{way}"], gates[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
            u_zr, u_c = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(LENGTH) if way == "f" else range(LENGTH - 1, -1, -1):
                g = own[rows[:, t]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u_zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u_c)
                step = z * (c - h)
                new = h + (step if full else step * mask[:, t : t + 1])
                if keep is not None:
                    keep[way, t] = (h, z, r, c)
                h = new
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        tanh = np.tanh(states @ self.p["a"])
        score = tanh @ self.p["v"] + (mask.T - 1) * np.float32(1e4)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"states": states, "tanh": tanh, "weight": weight, "pooled": pooled, "mask": mask}
        return pooled @ self.p["o"] + self.p["c"][0]

    def gradients(self, keep: dict, rows: np.ndarray, x: np.ndarray, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the inputs x. slope: d loss / d logit."""
        p, states, tanh, weight = self.p, keep["states"], keep["tanh"], keep["weight"]
        g = {"o": keep["pooled"].T @ slope, "c": np.array([slope.sum()], np.float32)}
        to_pooled = slope[:, None] * p["o"]
        to_states = weight[:, :, None] * to_pooled
        to_weight = np.einsum("tnh,nh->tn", states, to_pooled)
        to_score = weight * (to_weight - (weight * to_weight).sum(0))
        g["v"] = np.einsum("tna,tn->a", tanh, to_score)
        to_tanh = to_score[:, :, None] * p["v"] * (1 - tanh**2)
        g["a"] = np.einsum("tnh,tna->ha", states, to_tanh)
        to_states = to_states + to_tanh @ p["a"].T
        to_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, w = p[f"u{way}"], p[f"w{way}"]
            to_gates = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)  # the last row: no word
            g[f"u{way}"] = np.zeros_like(u)
            back = np.zeros((len(rows), HIDDEN), np.float32)
            for t in range(LENGTH - 1, -1, -1) if way == "f" else range(LENGTH):
                h, z, r, c = keep[way, t]
                back = back + to_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = keep["mask"][:, t : t + 1]
                to_new = back * m
                to_c = to_new * z * (1 - c**2)
                to_z = to_new * (c - h) * z * (1 - z)
                to_rh = to_c @ u[:, 2 * HIDDEN :].T
                to_r = to_rh * h * r * (1 - r)
                to_zr = np.concatenate([to_z, to_r], 1)
                g[f"u{way}"][:, : 2 * HIDDEN] += h.T @ to_zr
                g[f"u{way}"][:, 2 * HIDDEN :] += (r * h).T @ to_c
                np.add.at(to_gates, rows[:, t], np.concatenate([to_zr, to_c], 1))
                back = back * (1 - m) + to_new * (1 - z) + to_rh * r + to_zr @ u[:, : 2 * HIDDEN].T
            g[f"b{way}"] = to_gates[:-1].sum(0)
            g[f"w{way}"] = x.T @ to_gates[:-1]
            to_x += to_gates[:-1] @ w.T
        return g, to_x

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit, first word, size and text of every window, whole windows and last ones apart."""
        gates = self.projected(self.inputs(words))
        start, size, doc = words.windows()
        logits = np.empty(len(start), np.float32)
        for some in (np.flatnonzero(size == LENGTH), np.flatnonzero(size < LENGTH)):
            for at in range(0, len(some), BLOCK):
                part = some[at : at + BLOCK]
                logits[part] = self.run(gates, words.rows(start[part], size[part]))
        return logits, start, size, doc

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each text's worst window; a text without words has the probability of a window of none."""
        words = Words(texts)
        logits, _, _, doc = self.window_logits(words)
        worst = np.full(len(texts), self.p["c"][0], np.float64)
        if len(doc):
            worst[np.unique(doc)] = np.maximum.reduceat(logits, np.flatnonzero(np.diff(doc, prepend=-1)))
        return 1.0 / (1.0 + np.exp(-np.clip(worst, -30, 30)))


class Adam:
    """Adam for whole weights, and for the rows of a table that a batch has touched."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p, self.moments, self.step = weights, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}, 0

    def _moved(self, m: np.ndarray, v: np.ndarray, rate: float) -> np.ndarray:
        return (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)

    def whole(self, grads: dict[str, np.ndarray], rate: float) -> None:
        for k, grad in grads.items():
            m, v = self.moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            self.p[k] -= self._moved(m, v, rate)

    def rows(self, k: str, at: np.ndarray, grads: np.ndarray, rate: float) -> None:
        rows, back = np.unique(at, return_inverse=True)
        grad = np.stack([np.bincount(back, weights=grads[:, d], minlength=len(rows)) for d in range(grads.shape[1])], 1).astype(np.float32)
        m, v = self.moments[k]
        m[rows] += 0.1 * (grad - m[rows])
        v[rows] += 0.001 * (grad**2 - v[rows])
        self.p[k][rows] -= self._moved(m[rows], v[rows], rate)

    def inputs(self, net: Network, words: Words, used: np.ndarray, to_x: np.ndarray, rate: float) -> None:
        """The vectors behind the inputs of the distinct words `used`."""
        at = net.known(words.hashes[used])
        self.rows("word", at[at > 0], to_x[at > 0, :EMBED], rate)
        flat, _, counts = words.flat_grams(used)
        self.rows("gram", flat, np.repeat(to_x[:, EMBED:] / counts[:, None].astype(np.float32), counts, 0), rate)


def learn_vectors(net: Network, words: Words, labels: np.ndarray, rng: np.random.Generator, epochs: int, few: int) -> None:
    """The first step: vectors and a direction on which the words that make a text toxic stand out."""
    adam, prior = Adam(net.p), net.p["c"].copy()
    for epoch in range(epochs):
        rate = 2 * RATE * (1 - epoch / epochs)
        docs = rng.permutation(len(labels))
        for at in range(0, len(docs), few):
            part = docs[at : at + few]
            each = [np.unique(words.index[words.doc_starts[d] : words.doc_starts[d] + words.doc_lengths[d]]) for d in part.tolist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            starts = np.cumsum(sizes) - sizes
            used, back = np.unique(np.concatenate(each), return_inverse=True)
            x = net.inputs(words, used)
            s = (x @ net.p["u"])[back]
            weight = np.exp(np.float32(SHARP) * (s - np.repeat(np.maximum.reduceat(s, starts), sizes)))
            weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
            pooled = np.add.reduceat(weight * s, starts)
            slope = (_sigmoid(pooled + net.p["c"][0]) - labels[part]) / len(part)
            to_s = np.bincount(back, weights=np.repeat(slope, sizes) * weight * (1 + np.float32(SHARP) * (s - np.repeat(pooled, sizes))), minlength=len(used)).astype(np.float32)
            adam.step += 1
            adam.inputs(net, words, used, to_s[:, None] * net.p["u"], rate)
            adam.whole({"u": x.T @ to_s, "c": np.array([slope.sum()], np.float32)}, rate)
    net.p["c"][:] = prior


def fit(rows: list[tuple[bytes, int]], seed: int = 7) -> Network:
    """Adam on word attention first, then on the worst window of every training text, chosen anew in each epoch."""
    net, rng = Network(seed), np.random.default_rng(seed)
    rows = [(t, y) for t, y in rows if t.translate(_FOLD).split()]
    if not rows:
        return net
    words, labels = Words.of_many([t for t, _ in rows]), np.array([y for _, y in rows], np.int64)
    net.learn_vocabulary(words)
    net.p["gram"][np.bincount(words.gram, minlength=GRAMS) == 0] = 0  # n-grams that no training text has say nothing
    net.p["c"][:] = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    few = min(max(len(rows) * EPOCHS[1] // STEPS, 8), BATCH)  # few texts: smaller batches, so as many steps
    epochs = min(max(-(-STEPS * few // len(rows)), EPOCHS[0]), EPOCHS[1])
    learn_vectors(net, words, labels, rng, epochs, few)
    adam = Adam(net.p)
    for epoch in range(epochs):
        if epoch == 0:  # before the first step: the window with the strongest word of the first step
            start, size, doc = words.windows()
            strong = (net.inputs(words) @ net.p["u"])[words.index]
            worst = np.maximum.reduceat(np.append(strong, np.float32(-99)), np.stack([start, start + size], 1).ravel())[::2]
        else:
            worst, start, size, doc = net.window_logits(words)
        order = np.lexsort((-worst, doc))
        chosen = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        chosen = rng.permutation(chosen)
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(chosen), few):
            part = chosen[at : at + few]
            windows, y = words.rows(start[part], size[part]), labels[doc[part]].astype(np.float32)
            used = np.unique(windows[windows >= 0])
            windows = np.where(windows >= 0, np.searchsorted(used, windows), -1)
            x = np.concatenate((net.inputs(words, used), np.zeros((1, _INPUTS), np.float32)))
            blank = np.where(np.arange(LENGTH) < rng.integers(1, 2 * LENGTH, (1 + len(part) // BLANK, 1)), len(used), -1)
            windows, y = np.concatenate((windows, blank)), np.append(y, np.zeros(len(blank), np.float32))
            keep: dict = {}
            logit = net.run(net.projected(x), windows, keep)
            slope = (_sigmoid(logit) - y) / len(y)
            g, to_x = net.gradients(keep, windows, x, slope)
            adam.step += 1
            adam.whole(g, rate)
            adam.inputs(net, words, used, to_x[:-1], rate)
    return net


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "text"):
            scores = net.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def _scored(docs: DataFrame, labels: DataFrame, others: list) -> DataFrame:
    net = fit(training_rows(docs, labels, "toxic"))
    release()  # what training took goes back before the driver does anything else
    shared = docs.sparkSession.sparkContext.broadcast(net)
    frame = docs.select(*others, F.col("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return map_arrow(frame, _score(shared), f"{kinds}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (probability of toxic 1) and predicted (score >= 0.5) for every row of docs.

    Defined cases: null texts and texts without words score by the learned bias alone; one row for each input row,
    repeated rows alike; a null doc_id scores too and its held_out is null; without usable labels the network is
    untrained. Only texts are read to score; other columns of docs never count.
    """
    scored = _scored(docs, labels, [F.col("doc_id")])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns, each text as it is."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return _scored(docs, labels, [row]).where(F.col("score") < threshold).select("row.*")
