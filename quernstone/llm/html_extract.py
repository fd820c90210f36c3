"""Main text of web pages by a recurrent block labeller.

A page is its sequence of leaf blocks. Each block enters as learned vectors of its tag path (elements with the parts
of their class, id, role) and of its hashed words, with its length and the share of it inside links. A bidirectional
LSTM in numpy reads the whole page and labels every block as main text or not. There are no labelled pages, so the
network is trained on pages that a seeded generator builds from common layouts, with invented words as text.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, slices
from .features import Bytes
from .html_blocks import blocks

PATHS, WORDS, PATH_DIM, WORD_DIM, HIDDEN = 1 << 12, 1 << 14, 16, 6, 12
PAGES, EPOCHS, BATCH, RATE, HEARD = 480, 10, 16, 0.01, 0.5
_INPUTS = PATH_DIM + WORD_DIM + 3
_SPACES = np.zeros(256, bool)
_SPACES[32] = True

# Names that pages use for the container of their main text, and for everything else.
MAIN = ("article", "main", 'div id="content"', 'div class="post-content"', 'div class="entry-content"', 'section class="article-body"', 'div itemprop="articleBody"', 'div class="story"', 'div class="text"', 'main class="page"', 'article class="post"', 'div role="main"')
OTHER = {
    "nav": ("nav", 'div class="menu"', 'div id="navigation"', 'ul class="breadcrumb"', 'nav class="top-nav"', 'div role="navigation"', 'div class="navbar"', 'ul class="menu"', 'div class="pagination"', 'nav class="toc"'),
    "header": ("header", 'div id="header"', 'div class="site-header"', 'div class="masthead"', 'header class="banner"', 'div role="banner"', 'div class="topbar"'),
    "footer": ("footer", 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'footer class="legal"', 'div role="contentinfo"'),
    "aside": ("aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="widget"', 'div role="complementary"', 'div class="related-posts"', 'section class="recommended"', 'div class="trending"', 'div class="share"', 'div class="social"', 'div class="author-bio"'),
    "ad": ('div class="ad"', 'div class="advert"', 'div class="ads"', 'div class="sponsored"', 'div class="promo"', 'div class="banner-ad"', 'section class="advertisement"', 'div id="ad-slot"', 'aside class="ad"', 'p class="ad"'),
    "notice": ('div class="cookie-notice"', 'div class="notice"', 'div class="cookie-banner"', 'div class="consent"', 'div class="gdpr"', 'div class="popup"', 'div class="modal"', 'div class="alert"', 'p class="notice"', 'div class="paywall"', 'div role="alert"', 'div role="dialog"', 'div hidden'),
    "form": ("form", 'form class="search"', 'form class="newsletter"', 'div class="subscribe"', 'div class="login"', 'form id="contact"', 'div class="search-box"', 'div class="signup"'),
    "comments": ('section class="comments"', 'div id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div class="replies"', 'section id="discussion"', 'div class="reader-comments"', 'article class="comment"', 'div class="responses"'),
}
TALK = "menu home about contact login search share subscribe newsletter cookie cookies privacy policy terms copyright rights reserved advertisement sponsored comments reply related read more next previous follow sign up accept".split()


def _page(rng: random.Random) -> str:
    """A page in which every text starts with its label, 1 for main text."""
    letters = ["en", "er", "ti", "on", "sh", "ou", "ba", "ko", "é", "ß", "lu", "mi", "za", "pre"]
    say = lambda low, high: " ".join("".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))) + rng.choice([".", "", "!", "?"])
    close = lambda opened: f"</{opened.split()[0]}>"

    def other(kind: str) -> str:
        name = rng.choice(OTHER[kind])
        talk = lambda: " ".join(rng.sample(TALK, rng.randint(1, 3))) + " " if rng.random() < 0.4 else ""
        text = lambda low, high: "§0 " + talk() + say(low, high)
        if kind == "nav" or (kind in ("footer", "aside", "header") and rng.random() < 0.5):
            body = "".join(f'<li><a href="/x">{text(1, 3)}</a></li>' for _ in range(rng.randint(1, 7)))
            body = body if name.startswith("ul") else f"<ul>{body}</ul>"
        elif kind == "form":
            body = "".join(rng.choice([f"<label>{text(1, 3)}</label><input type=text><br>", f"<p>{text(2, 9)}</p>", f"<div>{text(1, 5)}</div>"]) for _ in range(rng.randint(1, 4)))
        elif kind == "comments":
            body = "".join(f'<div class="{rng.choice(["comment", "reply", "c"])}"><b>{text(1, 2)}</b><p>{text(3, 50)}</p></div>' for _ in range(rng.randint(1, 6)))
            body = (f"<h{(h := rng.randint(2, 4))}>{text(1, 4)}</h{h}>" if rng.random() < 0.5 else "") + body
        else:
            body = rng.choice([text(2, 25), f"<p>{text(2, 40)}</p>", f"<h{(h := rng.randint(1, 4))}>{text(1, 4)}</h{h}>" + rng.choice(["", f"<p>{text(3, 30)}</p><p>{text(3, 30)}</p>"]), f"<div>{text(2, 12)}</div>"])
        if kind != "nav" and not name.startswith(("ul", "ol", "p ")) and rng.random() < 0.12:
            body += other(kind)
        return f"<{name}>{body}{close(name)}"

    def main(depth: int = 0) -> str:
        kind = rng.random()
        talk = lambda: " " + " ".join(rng.sample(TALK, rng.randint(1, 2))) + " " if rng.random() < 0.3 else " "
        text = lambda low, high: "§1" + (talk() if rng.random() < 0.3 else " ") + say(low, high) + (talk() + say(1, 20) if high > 8 else "")
        if kind < 0.6:
            return rng.choice([f"<p>{text(1, 90)}</p>", f"<p><b>{text(2, 60)}<br>", f"<p>{text(5, 60)} <a href=x>{say(1, 3)}</a> {say(2, 30)}</p>", f"<p>{text(3, 40)}"])
        if kind < 0.7:
            return f"<h{(h := rng.randint(2, 4))}>{text(1, 8)}</h{h}>"
        if kind < 0.78:
            return "<ul>" + "".join(f"<li>{text(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote>{rng.choice(['', '<p>'])}{text(4, 30)}</blockquote>"
        if kind < 0.9:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{text(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if kind < 0.94:
            return f"<pre>{text(2, 30)}</pre>"
        if kind < 0.97:
            return f"<figure><figcaption>{text(2, 12)}</figcaption></figure>"
        return f"<div>{main(depth + 1)}</div>" if depth < 3 else f"<div>{text(2, 30)}</div>"

    before, after = ["header", "nav", "ad", "notice", "form", "aside"], ["footer", "aside", "ad", "comments", "notice", "form", "nav"]
    parts = [other(k) for k in before if rng.random() < 0.45]
    rng.shuffle(parts)
    inside = [f"<h1>§1 {say(2, 9)}</h1>"] if rng.random() < 0.7 else []
    for _ in range(rng.randint(1, 14)):
        inside.append(main())
        if rng.random() < 0.2:
            inside.append(other(rng.choice(["ad", "aside", "nav", "notice", "form", "comments"])))
    if rng.random() < 0.15:
        inside.append(other("comments"))
    names = [rng.choice(MAIN)] if rng.random() < 0.95 else []
    if rng.random() < 0.3:
        names.insert(0, rng.choice(["main", 'div class="wrap"', 'div class="container"', "section"]))
    if rng.random() < 0.25:
        names.append(rng.choice(['div class="body"', "section", "div"]))
    wrapped = "".join(f"<{n}>" for n in names) + "".join(inside) + "".join(close(n) for n in reversed(names))
    ends = [other(k) for k in after if rng.random() < 0.45]
    rng.shuffle(ends)
    if rng.random() < 0.5:
        ends.append(other("footer"))
    shell = ('<div class="page">', "</div>") if rng.random() < 0.25 else ("", "")
    return "<html><body>" + shell[0] + "".join(parts) + wrapped + "".join(ends) + shell[1] + rng.choice(["</body></html>", ""])


@lru_cache(maxsize=100_000)
def _path_features(path: tuple[str, ...]) -> tuple[int, ...]:
    """Hashed parts of the path: every element's words, and tag and words of the last elements with their place."""
    names = {f"in {w}" for e in path for w in e.split()}
    names |= {f"last {k} {w}" for k, e in enumerate(reversed(path[-2:])) for w in e.split()}
    names.add(f"depth {min(len(path), 8)}")
    return tuple(sorted({zlib.crc32(n.encode()) % PATHS for n in names}))


class Batch:
    """Blocks of some pages as flat arrays, and the places of pages in them."""

    def __init__(self, pages: list[list[tuple[tuple[str, ...], str, int]]]):
        flat = [b for page in pages for b in page]
        self.sizes = np.fromiter(map(len, pages), np.int64, len(pages))
        number: dict = {}
        self.path = np.fromiter((number.setdefault(p, len(number)) for p, _, _ in flat), np.int64, len(flat))
        self.paths = [np.array(_path_features(p), np.int64) for p in number]
        source = Bytes([t.lower().encode() for _, t, _ in flat])
        starts, ends, self.word_block = source.words(_SPACES)
        self.word = (source.hashes(starts, ends) % np.uint64(WORDS)).astype(np.int64)
        self.words = np.bincount(self.word_block, minlength=len(flat))
        chars = np.fromiter((len(t) for _, t, _ in flat), np.float32, len(flat))
        linked = np.fromiter((n for _, _, n in flat), np.float32, len(flat))
        self.scalars = np.stack([np.log1p(chars) / 5, np.minimum(linked / np.maximum(chars, 1), 1), np.ones_like(chars)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Labeller:
    """Weights, forward pass and gradients. Gates are in the order input, forget, output, candidate."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"path": (0.3 * rng.normal(size=(PATHS, PATH_DIM))).astype(np.float32), "word": (0.1 * rng.normal(size=(WORDS, WORD_DIM))).astype(np.float32), "o": draw(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}
        for way in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"w{way}": draw(_INPUTS, 4 * HIDDEN), f"u{way}": draw(HIDDEN, 4 * HIDDEN), f"b{way}": bias}

    def inputs(self, batch: Batch) -> np.ndarray:
        x = np.zeros((len(batch.path), _INPUTS), np.float32)
        if not len(x):
            return x
        x[:, :PATH_DIM] = np.stack([self.p["path"][f].sum(0) for f in batch.paths])[batch.path] * np.float32(0.5)
        for k in range(WORD_DIM):
            total = np.bincount(batch.word_block, weights=self.p["word"][batch.word, k], minlength=len(x))
            x[:, PATH_DIM + k] = total / np.maximum(batch.words, 1)
        x[:, PATH_DIM + WORD_DIM :] = batch.scalars
        return x

    def run(self, x: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits [steps, pages]; at: block numbers [steps, pages], -1 after a page's last block."""
        steps, n = at.shape
        mask = (at >= 0).astype(np.float32)[:, :, None]
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for k, way in enumerate("fb"):
            gates = np.concatenate([x @ self.p[f"w{way}"] + self.p[f"b{way}"], np.zeros((1, 4 * HIDDEN), np.float32)])
            h = c = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                g = gates[at[t]] + h @ self.p[f"u{way}"]
                s = _sigmoid(g[:, : 3 * HIDDEN])
                i, f, o, z = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
                cell = f * c + i * z
                tanh = np.tanh(cell)
                if keep is not None:
                    keep[way, t] = (h, c, i, f, o, z, tanh)
                h, c = h + mask[t] * (o * tanh - h), c + mask[t] * (cell - c)
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        if keep is not None:
            keep["states"], keep["mask"] = states, mask
        return states @ self.p["o"] + self.p["c"][0]

    def gradients(self, keep: dict, x: np.ndarray, at: np.ndarray, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the inputs; slope: d loss / d logit, 0 where no block is."""
        p, mask = self.p, keep["mask"]
        g = {"o": np.einsum("tnh,tn->h", keep["states"], slope), "c": np.array([slope.sum()], np.float32)}
        to_states, to_x = slope[:, :, None] * p["o"], np.zeros_like(x)
        for k, way in enumerate("fb"):
            to_gates = np.zeros((len(x) + 1, 4 * HIDDEN), np.float32)
            g[f"u{way}"] = np.zeros_like(p[f"u{way}"])
            to_h = to_c = np.zeros((at.shape[1], HIDDEN), np.float32)
            for t in range(len(at) - 1, -1, -1) if way == "f" else range(len(at)):
                h, c, i, f, o, z, tanh = keep[way, t]
                m = mask[t]
                to_h = to_h + to_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                new_h, new_c = to_h * m, to_c * m
                cell = new_c + new_h * o * (1 - tanh**2)
                to_g = np.concatenate([cell * z * i * (1 - i), cell * c * f * (1 - f), new_h * tanh * o * (1 - o), cell * i * (1 - z**2)], 1)
                g[f"u{way}"] += h.T @ to_g
                np.add.at(to_gates, at[t], to_g)
                to_h, to_c = to_h * (1 - m) + to_g @ p[f"u{way}"].T, to_c * (1 - m) + cell * f
            g[f"b{way}"] = to_gates[:-1].sum(0)
            g[f"w{way}"] = x.T @ to_gates[:-1]
            to_x += to_gates[:-1] @ p[f"w{way}"].T
        return g, to_x

    def labels(self, pages: list[list]) -> list[np.ndarray]:
        """For each page, whether each block is main text. Pages of like length run together; no page is cut."""
        batch = Batch(pages)
        x, begins = self.inputs(batch), np.cumsum(batch.sizes) - batch.sizes
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = np.argsort(batch.sizes, kind="stable")
        order = order[batch.sizes[order] > 0]
        at = 0
        while at < len(order):
            some = order[at : at + 256]
            while len(some) > 1 and batch.sizes[some[-1]] * len(some) > 1 << 16 and batch.sizes[some[-1]] > 2 * batch.sizes[some[0]]:
                some = some[: len(some) // 2]
            at += len(some)
            steps = np.arange(batch.sizes[some].max())[:, None]
            logits = self.run(x, np.where(steps < batch.sizes[some], begins[some] + steps, -1))
            for column, page in enumerate(some.tolist()):
                out[page] = logits[: batch.sizes[page], column] > 0
        return out


def training_pages(count: int = PAGES, seed: int = 11) -> list[tuple[list, np.ndarray]]:
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        found = [(path, text, linked) for path, text, linked in blocks(_page(rng)) if text.startswith("§")]
        out.append(([(path, text[3:], linked) for path, text, linked in found], np.array([text[1] == "1" for _, text, _ in found])))
    return [x for x in out if len(x[1])]


@lru_cache(maxsize=1)
def trained(seed: int = 5) -> Labeller:
    """Adam on generated pages; the same weights in every process."""
    net, rng, pages = Labeller(seed), np.random.default_rng(seed), training_pages()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, total = 0, EPOCHS * -(-len(pages) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pages))
        for start in range(0, len(order), BATCH):
            some = [pages[i] for i in order[start : start + BATCH]]
            batch = Batch([b for b, _ in some])
            x, steps = net.inputs(batch), np.arange(batch.sizes.max())[:, None]
            at = np.where(steps < batch.sizes, np.cumsum(batch.sizes) - batch.sizes + steps, -1)
            y = np.concatenate([y for _, y in some]).astype(np.float32)
            heard = (rng.random((len(x), 1)) < HEARD).astype(np.float32)  # blocks whose words count: unseen words must not
            x[:, PATH_DIM : PATH_DIM + WORD_DIM] *= heard
            keep: dict = {}
            logit = net.run(x, at, keep)
            slope = np.where(at >= 0, _sigmoid(logit) - y[at], 0).astype(np.float32) / len(y)
            g, to_x = net.gradients(keep, x, at, slope)
            g["path"], g["word"] = np.zeros_like(net.p["path"]), np.zeros_like(net.p["word"])
            to_path = np.zeros((len(batch.paths), PATH_DIM), np.float32)
            np.add.at(to_path, batch.path, to_x[:, :PATH_DIM] * np.float32(0.5))
            for f, grad in zip(batch.paths, to_path, strict=True):
                g["path"][f] += grad
            np.add.at(g["word"], batch.word, (heard * to_x[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(batch.words, 1)[:, None])[batch.word_block])
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    # words and parts of paths that training did not show say nothing
    seen = Batch([b for b, _ in pages])
    net.p["word"][np.bincount(seen.word, minlength=WORDS) == 0] = 0
    net.p["path"][np.bincount(np.concatenate(seen.paths), minlength=PATHS) == 0] = 0
    return net


def extract(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(text for (_, text, _), main in zip(page, labels, strict=True) if main) for page, labels in zip(found, net.labels(found), strict=True)]


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "html"):
            texts = extract([t or "" for t in batch.column("html").to_pylist()], net)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages; no shuffle.

    text joins the main blocks in page order by one newline; n_chars counts its code points. Defined cases: null or
    empty html, or a page without main blocks, gives an empty text; a null id or url stays null; repeated rows each get
    a row; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return map_arrow(pages.select("page_id", "url", F.col("html")), _extract(shared), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
