"""Quality: a byte-level convolutional network in numpy.

Every byte has an embedding. Learned filters eight bytes wide step through the text four bytes at a time. Their
responses are averaged and maximised over overlapping chunks of CHUNK bytes that together cover the whole document; a
learned layer turns each chunk's summary into features, whose maxima over all chunks give one probability.

Defined cases: null and empty texts are one chunk of padding and get its score; with labels of one class only, every
score is the share of positives (0.5 without labels). Repeated rows are scored each. Texts of any length are scored
whole, long ones in parts; labelled texts of over toxicity.MAX_TEXT bytes are not learnt from. Columns that clash with
an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import plus
from .toxicity import fitted, platt, sample

QUAD = 4
#: A block is 16 quads; a chunk is 4 blocks and begins every 3 blocks, so neighbours share one.
BLOCK, BLOCKS, HOP = 64, 4, 3
CHUNK = BLOCK * BLOCKS
DIMS, FILTERS, FEATURES = 6, 16, 24
#: Bounds of the labelled sample: rows and bytes together (and of a text, see toxicity.MAX_TEXT).
MAX_ROWS, MAX_BYTES = 6000, 48 << 20
#: Bytes that are scored at once.
PART = 1 << 18
EPOCHS, STEPS, GROUP = 6, 800, 16


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and chunks of documents of these byte sizes."""
    blocks = np.maximum(1, -(-sizes // BLOCK))
    chunks = np.maximum(1, -(-(blocks - 1) // HOP))
    return blocks, chunks


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents laid out so that each fills whole chunks (BLOCK * (HOP * chunks + 1) bytes), zeros behind; and its first chunk (n + 1)."""
    sizes = np.diff(offs)
    _, chunks = layout(sizes)
    room = BLOCK * (HOP * chunks + BLOCKS - HOP)
    begin = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(begin - offs[:-1], sizes)] = data
    return out, np.concatenate([[0], np.cumsum(chunks)])


@dataclass
class ByteNet:
    embed: np.ndarray
    kernel: np.ndarray  # (2 * QUAD * DIMS) x FILTERS
    bias: np.ndarray
    mid: np.ndarray  # (2 * FILTERS) x FEATURES
    mid_bias: np.ndarray
    out: np.ndarray
    shift: float
    constant: float | None = None

    @classmethod
    def new(cls, rng: np.random.Generator) -> ByteNet:
        n = lambda *s, x: rng.normal(0, x, s).astype(np.float32)
        return cls(n(256, DIMS, x=0.5), n(2 * QUAD * DIMS, FILTERS, x=0.25), np.zeros(FILTERS, np.float32), n(2 * FILTERS, FEATURES, x=0.25), np.zeros(FEATURES, np.float32), n(FEATURES, x=0.3), 0.0)

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Rectified filter responses at each quad of rows of bytes; beyond a row's end there are zeros."""
        rows, width = raw.shape
        half = QUAD * DIMS
        x = self.embed[raw].reshape(rows * width // QUAD, half)
        y = (x @ self.kernel[:half]).reshape(rows, -1, FILTERS)
        y[:, :-1] += (x @ self.kernel[half:]).reshape(rows, -1, FILTERS)[:, 1:]
        return np.maximum(y + self.bias, 0)

    def features(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([mean, top], 1) @ self.mid + self.mid_bias, 0)

    def chunk_features(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Features of every chunk of padded documents; filters run block by block, so that shared blocks are computed once."""
        r = self.responses(raw.reshape(-1, BLOCK))
        mean, top = r.mean(1), r.max(1)
        docs = len(first) - 1
        chunks = np.diff(first)
        block0 = np.cumsum(HOP * chunks + BLOCKS - HOP) - (HOP * chunks + BLOCKS - HOP)
        at = np.repeat(block0 - HOP * first[:-1], chunks) + HOP * np.arange(first[-1])
        assert docs == len(chunks)
        m, t = mean[at] / BLOCKS, top[at]
        for j in range(1, BLOCKS):
            m += mean[at + j] / BLOCKS
            np.maximum(t, top[at + j], out=t)
        return self.features(m, t)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        docs = len(offs) - 1
        if self.constant is not None:
            return np.full(docs, self.constant)
        f = np.empty((docs, len(self.out)), np.float32)
        step = HOP * BLOCK * (PART // (HOP * BLOCK))
        for a, b in tk.slices(offs, PART):
            lo, hi = int(offs[a]), int(offs[b])
            if b == a + 1 and hi - lo > step:
                # A long text goes by parts of whole chunks, which share a block with the next part.
                f[a] = 0
                for i in range(lo, hi, step):
                    part = data[i : min(i + step + BLOCK * (BLOCKS - HOP), hi)]
                    if i > lo and len(part) <= BLOCK * (BLOCKS - HOP):
                        break  # the part before has seen these bytes
                    raw, first = padded(part, np.array([0, len(part)]))
                    np.maximum(f[a], self.chunk_features(raw, first).max(0), out=f[a])
                continue
            raw, first = padded(data[lo:hi], offs[a : b + 1] - lo)
            f[a:b] = np.maximum.reduceat(self.chunk_features(raw, first), first[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip((f @ self.out).astype(np.float64) + self.shift, -30, 30)))


def train(texts: list[str], y: np.ndarray, seed: int = 11) -> ByteNet:
    return trained(*tk.buffers(pa.array(texts, pa.large_string())), np.arange(len(y)), y, seed)


def trained(data: np.ndarray, offs: np.ndarray, members: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteNet:
    """Adam on the log loss over these members, whose labels are y. A document's maxima come from few chunks; only those are gone back through."""
    rng = np.random.default_rng(seed)
    net = ByteNet.new(rng)
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    net.shift = float(np.log(y.mean() / (1 - y.mean())))
    names = ("embed", "kernel", "bias", "mid", "mid_bias", "out")
    mom = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    half = QUAD * DIMS
    epochs = max(EPOCHS, -(-STEPS * GROUP // len(y)))
    step, last = 0, epochs * max(1, len(y) // GROUP)
    for _ in range(epochs):
        for group in np.array_split(rng.permutation(len(y)), max(1, len(y) // GROUP)):
            step += 1
            parts = [data[offs[i] : offs[i + 1]] for i in members[group]]
            raw, first = padded(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            f = net.chunk_features(raw, first)
            arg = np.stack([first[i] + f[first[i] : first[i + 1]].argmax(0) for i in range(len(group))])
            p = f[arg, np.arange(FEATURES)]
            z = p @ net.out + net.shift
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[group]) / len(group)).astype(np.float32)
            grads = {"out": p.T @ g + 1e-4 * net.out}
            dp = g[:, None] * net.out * (p > 0)
            used, back = np.unique(arg, return_inverse=True)
            df = np.zeros((len(used), FEATURES), np.float32)
            np.add.at(df, (back.reshape(arg.shape), np.arange(FEATURES)[None, :]), dp)
            doc = np.searchsorted(first, used, "right") - 1
            chunks = np.diff(first)
            room = HOP * chunks + BLOCKS - HOP
            block = (np.cumsum(room) - room)[doc] + HOP * (used - first[doc])
            rows = raw.reshape(-1, BLOCK)[(block[:, None] + np.arange(BLOCKS)).ravel()]
            r = net.responses(rows)
            by = r.reshape(len(used), -1, FILTERS)
            mean, at = by.mean(1), by.argmax(1)
            top = np.take_along_axis(by, at[:, None, :], 1)[:, 0]
            pre = np.concatenate([mean, top], 1)
            grads["mid"], grads["mid_bias"] = pre.T @ df, df.sum(0)
            dpre = df @ net.mid.T
            dr = np.repeat(dpre[:, None, :FILTERS] / by.shape[1], by.shape[1], 1)
            i, c = np.indices(at.shape)
            dr[i, at, c] += dpre[:, FILTERS:]
            dr = (dr * (by > 0)).reshape(len(rows), -1, FILTERS)
            x = net.embed[rows].reshape(len(rows), -1, half)
            flat = dr.reshape(-1, FILTERS)
            ahead = dr[:, :-1].reshape(-1, FILTERS)
            grads["bias"] = flat.sum(0)
            grads["kernel"] = np.concatenate([x.reshape(-1, half).T @ flat, x[:, 1:].reshape(-1, half).T @ ahead])
            dx = (flat @ net.kernel[:half].T).reshape(x.shape)
            dx[:, 1:] += (ahead @ net.kernel[half:].T).reshape(x[:, 1:].shape)
            each, ids = dx.reshape(-1, DIMS), rows.ravel()
            grads["embed"] = np.stack([np.bincount(ids, each[:, d], 256) for d in range(DIMS)], 1)
            rate = 0.01 * (1 - step / (last + 1))
            net.shift -= rate * float(g.sum()) * 10
            for k in names:
                a, b = mom[k]
                a += 0.1 * (grads[k] - a)
                b += 0.01 * (grads[k] ** 2 - b)
                value = getattr(net, k)
                value -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def fit_rows(texts: list[str], y: np.ndarray, held: np.ndarray) -> ByteNet:
    """Fit on the rows that aren't held, then set slope and shift of the logit by those that are."""
    return _calibrated(*tk.buffers(pa.array(texts, pa.large_string())), y, held)


def _calibrated(data: np.ndarray, offs: np.ndarray, y: np.ndarray, held: np.ndarray) -> ByteNet:
    every = np.arange(len(y))
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        return trained(data, offs, every, y)
    net = trained(data, offs, every[~held], y[~held])
    score = np.concatenate([net.scores(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]])) for i in every[held]])
    a, c = platt(score, y[held])
    net.out, net.shift = net.out * np.float32(a), net.shift * a + c
    return net


def fit(documents: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> ByteNet:
    """Fit on at most max_rows labelled texts of at most max_bytes together, of label rows where learn_from holds."""
    lab = labels.where(learn_from).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = sample(docs, lab, max_rows, max_bytes)
    if rows is None:
        return train([], np.zeros(0, np.float32))

    def learn(t: pa.Table) -> ByteNet:
        column = t.column("text").cast(pa.large_string()).combine_chunks()
        return _calibrated(*tk.buffers(column), t.column("y").to_numpy().astype(np.float32), t.column("rank").to_numpy() % 8 == 0)

    return fitted(rows, learn)


def score(documents: DataFrame, net: ByteNet, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """documents with the probability of label 1 of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in documents.columns if c.lower() != score_col.lower()]
    base = documents.select(*[F.col(f"`{c}`") for c in keep])
    text_at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(*tk.buffers(batch.column(text_at))), pa.float64())], names=[*batch.schema.names, score_col])

    return base.mapInArrow(run, plus(base, **{score_col: "double"}))
