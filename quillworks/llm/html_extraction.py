"""Main text of web pages by a recurrent block labeller.

A page is its sequence of leaf blocks. Each block is a vector: hashed embeddings of its tag path (element names and the
words of their class and id), of its own element, and of its words, and a few measures. A bidirectional LSTM in numpy
reads the sequence, so every block is labelled with the whole page in view; blocks labelled main text are the result.
The labeller is trained on generated pages (html_pages), for no given table has labelled blocks.

Defined results: a null, empty or textless page gives the empty text; repeated rows each get a row; ids and urls may be
null; extra columns are ignored; an empty table gives an empty result. A `<br>` is white space inside its block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common, html_blocks, html_pages
from quillworks.llm.common import received, send, worker_state
from quillworks.llm.html_blocks import Block, blocks_of
from quillworks.llm.html_pages import PageMaker

for _name in (__name__, html_blocks.__name__, html_pages.__name__):
    common.ship(_name)

PATHS, WORDS = 1 << 12, 1 << 12
PATH_DIMS, LEAF_DIMS, WORD_DIMS, MEASURES, HIDDEN = 16, 8, 6, 7, 16
INPUT = PATH_DIMS + LEAF_DIMS + WORD_DIMS + MEASURES
HEADINGS = frozenset(f"<h{k}>" for k in range(1, 7))


def hashed(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


@dataclass
class Labeller:
    """Weights by name: path, leaf, word (embeddings); wx, wh, b for each direction (0 forward, 1 backward); out, out_b."""

    p: dict[str, np.ndarray]


def new_labeller(seed: int) -> Labeller:
    rng = np.random.default_rng(seed)
    p = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIMS)), "leaf": rng.normal(0, 0.3, (PATHS, LEAF_DIMS)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIMS))}
    for d in "01":
        p["wx" + d], p["wh" + d] = rng.normal(0, 0.2, (INPUT, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        p["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["out"], p["out_b"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
    return Labeller({k: v.astype(np.float32) for k, v in p.items()})


@dataclass
class Indexed:
    """A page as numbers: bucket lists of its blocks, and their measures."""

    paths: list[list[int]]
    leaves: list[int]
    words: list[list[int]]
    measures: np.ndarray


class Indexer:
    """Blocks to numbers, with bounded caches of path parts and words."""

    def __init__(self, most: int = 200_000):
        self.most, self.path, self.word = most, {}, {}

    def of(self, blocks: list[Block]) -> Indexed:
        if len(self.path) + len(self.word) > self.most:
            self.path, self.word = {}, {}
        paths, leaves, words, measures = [], [], [], np.zeros((len(blocks), MEASURES), dtype=np.float32)
        n = len(blocks)
        for k, block in enumerate(blocks):
            if block.path not in self.path:
                tags = [x for x in block.path if x[0] == "<"]
                leaf = tags[-1] if tags else ""
                self.path[block.path] = [hashed(x, PATHS) for x in dict.fromkeys(block.path)] or [hashed("", PATHS)], hashed(leaf, PATHS), leaf in HEADINGS
            path, leaf, heading = self.path[block.path]
            paths.append(path)
            leaves.append(leaf)
            own = []
            for w in block.text.lower().split():
                if (b := self.word.get(w)) is None:
                    b = self.word[w] = hashed(w.strip(".,;:!?"), WORDS)
                own.append(b)
            words.append(own)
            size = len(block.text)
            measures[k] = (np.log1p(size) / 6, min(1.0, block.link_chars / size), heading, k / n, (n - 1 - k) / n, min(1.0, len(own) / 40), block.text[-1] in ".!?")
        return Indexed(paths, leaves, words, measures)


def bag(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """The mean embedding of each list; no list is empty."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])
    return np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None].astype(np.float32)


def inputs(model: Labeller, page: Indexed) -> np.ndarray:
    return np.hstack([bag(model.p["path"], page.paths), model.p["leaf"][page.leaves], bag(model.p["word"], page.words), page.measures]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """Hidden states over time of x (time, pages, INPUT); masked steps carry the state on."""
    h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    pre, out, steps = x @ wx + b, np.empty((*x.shape[:2], HIDDEN), dtype=np.float32), []
    for t in range(len(x)):
        z = pre[t] + h @ wh
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        m = mask[t][:, None]
        if keep:
            steps.append((h, c, i, f, o, g, tc, m))
        c, h = m * new_c + (1 - m) * c, m * (o * tc) + (1 - m) * h
        out[t] = h
    return (out, steps) if keep else out


def lstm_back(d_out: np.ndarray, x: np.ndarray, steps: list, wx: np.ndarray, wh: np.ndarray):
    """Gradients of wx, wh, b and x."""
    d_wx, d_wh, d_b, d_x = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1], dtype=np.float32), np.empty_like(x)
    dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = steps[t]
        dh = dh + d_out[t]
        a, kept = dh * m, dh * (1 - m)
        d_c = dc * m + a * o * (1 - tc * tc)
        dz = np.hstack([d_c * g * i * (1 - i), d_c * c * f * (1 - f), a * tc * o * (1 - o), d_c * i * (1 - g * g)])
        d_wx += x[t].T @ dz
        d_wh += h.T @ dz
        d_b += dz.sum(axis=0)
        d_x[t] = dz @ wx.T
        dh, dc = dz @ wh.T + kept, d_c * f + dc * (1 - m)
    return d_wx, d_wh, d_b, d_x


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, rows)), len(rows), INPUT), dtype=np.float32)
    mask = np.zeros(x.shape[:2], dtype=np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


def probabilities(model: Labeller, rows: list[np.ndarray]) -> list[np.ndarray]:
    """P(main text) of every block of every page. Pages of like length go together."""
    p, out = model.p, [np.zeros(0)] * len(rows)
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 256 and len(rows[order[end]]) <= 2 * len(rows[order[at]]) + 4 and len(rows[order[end]]) * (end + 1 - at) <= 60_000:
            end += 1
        own = order[at:end]
        x, mask = padded([rows[k] for k in own])
        ahead = lstm(x, mask, p["wx0"], p["wh0"], p["b0"])
        back = lstm(x[::-1], mask[::-1], p["wx1"], p["wh1"], p["b1"])[::-1]
        y = sigmoid(np.concatenate([ahead, back], axis=2) @ p["out"] + p["out_b"])
        for j, k in enumerate(own):
            out[k] = y[: len(rows[k]), j]
        at = end
    return out


def train_labeller(pages: int = 2_400, seed: int = 11, epochs: int = 4, batch: int = 24, rate: float = 0.01) -> Labeller:
    """Adam on generated pages, backward through time in both directions."""
    maker, indexer, model = PageMaker(seed), Indexer(), new_labeller(seed)
    made = []
    for _ in range(pages):
        page, labels = maker.page()
        blocks = blocks_of(page)
        if blocks and len(blocks) == len(labels):
            made.append((indexer.of(blocks), np.array(labels, dtype=np.float32)))
    p = model.p
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(made))
        order = np.concatenate(sorted(np.array_split(order, max(1, len(order) // batch)), key=lambda _: rng.random()))
        for at in range(0, len(order), batch):
            own = [made[k] for k in order[at : at + batch]]
            x, mask = padded([inputs(model, page) for page, _ in own])
            y = np.zeros(mask.shape, dtype=np.float32)
            for k, (_, labels) in enumerate(own):
                y[: len(labels), k] = labels
            ahead, s0 = lstm(x, mask, p["wx0"], p["wh0"], p["b0"], keep=True)
            back, s1 = lstm(x[::-1], mask[::-1], p["wx1"], p["wh1"], p["b1"], keep=True)
            both = np.concatenate([ahead, back[::-1]], axis=2)
            err = ((sigmoid(both @ p["out"] + p["out_b"]) - y) * mask / mask.sum()).astype(np.float32)
            grads = {"out": np.tensordot(err, both, 2), "out_b": np.array([err.sum()])}
            d_both = err[:, :, None] * p["out"]
            grads["wx0"], grads["wh0"], grads["b0"], d_x = lstm_back(d_both[:, :, :HIDDEN], x, s0, p["wx0"], p["wh0"])
            grads["wx1"], grads["wh1"], grads["b1"], d_back = lstm_back(d_both[::-1, :, HIDDEN:], x[::-1], s1, p["wx1"], p["wh1"])
            d_x += d_back[::-1]
            for name in ("path", "leaf", "word"):
                grads[name] = np.zeros_like(p[name])
            for k, (page, labels) in enumerate(own):
                d = d_x[: len(labels), k]
                for name, lists, part in (("path", page.paths, d[:, :PATH_DIMS]), ("word", page.words, d[:, PATH_DIMS + LEAF_DIMS : INPUT - MEASURES])):
                    sizes = np.array([len(z) for z in lists])
                    np.add.at(grads[name], np.concatenate(lists), np.repeat(part / sizes[:, None], sizes, axis=0))
                np.add.at(grads["leaf"], page.leaves, d[:, PATH_DIMS : PATH_DIMS + LEAF_DIMS])
            step += 1
            slower = max(0.05, 1 - step * batch / (epochs * len(made)))
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = (p[name] - rate * slower * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def labeller() -> Labeller:
    """The trained labeller; one training per process."""
    state = worker_state()
    if "labeller" not in state:
        state["labeller"] = train_labeller()
    return state["labeller"]


def extract_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html", keep_cols: tuple[str, ...] = ("url",), least: float = 0.5) -> DataFrame:
    """One row per page: id, the columns kept, text (main blocks joined by line feeds), n_chars, n_blocks, n_main."""
    sent = send(pages.sparkSession, model)

    @F.pandas_udf("struct<text string, n_blocks long, n_main long>")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        indexer, model = Indexer(), received(sent)
        for series in batches:
            rows: list[tuple[str, int, int]] = []
            for at in range(0, len(series), 500):
                found = [blocks_of(x or "") for x in series.iloc[at : at + 500]]
                scores = probabilities(model, [inputs(model, indexer.of(b)) if b else np.zeros((0, INPUT)) for b in found])
                for blocks, s in zip(found, scores, strict=True):
                    main = [b.text for b, y in zip(blocks, s, strict=True) if y >= least]
                    rows.append(("\n".join(main), len(blocks), len(main)))
            yield pd.DataFrame(rows, columns=["text", "n_blocks", "n_main"])

    out = pages.select(F.col(id_col), *[F.col(c) for c in keep_cols], main_text(F.col(html_col)).alias("main_part"))
    text = F.col("main_part.text")
    return out.select(id_col, *keep_cols, text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.col("main_part.n_blocks").alias("n_blocks"), F.col("main_part.n_main").alias("n_main"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"), labeller())
