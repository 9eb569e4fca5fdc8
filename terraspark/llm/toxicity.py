"""Toxicity: a convolutional text classifier over hashed word embeddings, trained and run in numpy.

A word is a run of letters, digits and non-ASCII characters, lower-cased in A-Z. Its vector joins three hashed
embeddings: two of the whole word by independent hashes, so that a single collision cannot pass for a word, and one
of its first bytes, for inflected forms. Filters one, two and three words wide run over the whole text; each one's
largest response goes into a logistic output. Decision thresholds are calibrated for each language.

Up to MAX_ROWS labelled texts are learnt in one task. More are dealt to parts by a hash; word statistics are summed over
all parts, and in each of ROUNDS rounds every part goes on from the common model through all its texts, after which each
weight moves by the mean of the parts that moved it. Thresholds come from the numbers of held-back texts by score. What
parts learn goes from round to round through the shared folder; the driver sees the last model alone.

Defined cases: null and empty texts, and texts without a word, get the score of all-zero features; with labels of one
class only, every score is the share of positives (0 without labels). Repeated rows are scored each. A label row whose
id has several documents is learnt with each of them. All labelled texts are learnt from and scored whole, long ones in
parts. Columns that clash with an output's name are replaced.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import materialise, plus, scratch, with_columns

BUCKETS = 1 << 16
WIDTH = 6
FILTERS = {1: 16, 2: 8, 3: 8}
PREFIX = 6
#: Labelled rows that are learnt in one task, and bytes of a part of more. For sample(): its bounds, and that of a text.
MAX_ROWS, MAX_BYTES, MAX_TEXT = 6000, 48 << 20, 1 << 18
#: Rows of a part, as a multiple of MAX_ROWS; parts that more rows have at least, where each gets MAX_ROWS; rounds.
PART_ROWS, PARTS, ROUNDS = 4, 8, 3
#: Labels up to which a table of them is broadcast; words that are learnt from at once; numbers in a row of what parts send, and tasks that add these up.
FEW, WORDS, SENT, ADDERS = 1_000_000, 1 << 16, 1 << 15, 16
#: Scores of held-back texts are told apart by logits this fine.
FINE = 256
#: Bytes that are scored at once; a longer text is scored in parts of so many.
PART = 1 << 18
EPOCHS, STEPS, GROUP = 10, 500, 32
#: Numbers of a model without its sums, and a power of two beyond those with them.
MODEL, BIG = 3 * BUCKETS * WIDTH + sum((k * 3 * WIDTH + 2) * f for k, f in FILTERS.items()) + 1, 1 << 24


def sample(documents: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, max_text: int = MAX_TEXT) -> DataFrame | None:
    """(rank, text, y, ...) to learn from: documents (id, text, ...) of up to max_rows labels (id, y), at most max_bytes together and max_text each.

    This is the stated bound of what is learnt from. Which labels are taken is decided by a hash of the id, from the
    labels alone; those few ids are broadcast, so documents are read where they lie. The driver sees ids and sizes of
    the sample; its texts lie in the shared folder.
    """
    top = labels.where(F.col("id").isNotNull() & F.col("y").isNotNull()).select("id", F.col("y").cast("double").alias("y")).distinct().orderBy(F.xxhash64("id"), "y").limit(max_rows).collect()
    if not top:
        return None
    few = documents.sparkSession.createDataFrame([(r["id"], r["y"]) for r in top], T.StructType([T.StructField("id", labels.schema["id"].dataType), T.StructField("y", T.DoubleType())]))
    df = documents.withColumn("text", F.coalesce("text", F.lit(""))).where(F.octet_length("text") <= max_text)
    df = df.join(F.broadcast(few), "id").withColumn("rank", F.xxhash64("id", "text"))
    total, last = 0, None
    for r in df.select("rank", F.octet_length("text").alias("size")).orderBy("rank", "size").limit(max_rows).collect():
        total += r["size"]
        if total > max_bytes and last is not None:
            break
        last = r["rank"]
    if last is None:
        return None
    return materialise(df.where(F.col("rank") <= last).orderBy("rank").limit(max_rows).drop("id"), "sample")


def fitted(rows: DataFrame, learn: Callable[[pa.Table], object]) -> object:
    """What learn makes of the sample, in one task that reads it from the shared folder; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).sort_by([("rank", "ascending"), ("text", "ascending"), ("y", "ascending")])
            held.clear()
            model = pickle.dumps(learn(table))
            del table
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    return pickle.loads(rows.coalesce(1).mapInArrow(run, "model binary").first()["model"])


@dataclass
class ConvText:
    """The model. tables: three of BUCKETS x WIDTH; kernels by width: width x inputs x filters."""

    tables: list[np.ndarray] = field(default_factory=list)
    kernels: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def buckets(w: tk.Words) -> np.ndarray:
        h = tk.word_hashes(w)
        p = tk.word_hashes(w, PREFIX)
        m = np.uint64(BUCKETS - 1)
        return np.stack([(h & m), (h >> np.uint64(40)) & m, (p >> np.uint64(20)) & m], 1).astype(np.uint16)

    def vectors(self, b: np.ndarray) -> np.ndarray:
        return np.concatenate([t[b[:, i]] for i, t in enumerate(self.tables)], 1)

    def maps(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Responses of all filters at every word; a window that runs over its text's end sees zeros there."""
        n = len(x)
        out = []
        for k, w in self.kernels.items():
            y = x @ w[0]
            for j in range(1, min(k, n)):
                part = x[j:] @ w[j]
                part[doc[j:] != doc[: n - j]] = 0
                y[: n - j] += part
            out.append(y + self.bias[k])
        return np.concatenate(out, 1)

    def pooled(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest response of each filter by document, at least 0."""
        size = np.diff(first)
        p = np.zeros((len(size), len(self.out)), np.float32)
        has = np.flatnonzero(size)
        if len(has):
            p[has] = np.maximum(np.maximum.reduceat(self.maps(x, np.repeat(np.arange(len(size)), size)), first[has], axis=0), 0)
        return p

    def maxima(self, b: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled responses of these rows of the features and the words that they begin at, by pieces of at most WORDS words."""
        total, behind = len(self.out), max(self.kernels) - 1
        p, arg = np.zeros((len(rows), total), np.float32), np.zeros((len(rows), total), np.int64)
        held: list[tuple[int, int, int, int]] = []

        def finish() -> None:
            size = [end - lo for _, lo, _, end in held]
            m = self.maps(self.vectors(np.concatenate([b[lo:end] for _, lo, _, end in held])), np.repeat(np.arange(len(held)), size))
            for (i, lo, hi, _), at in zip(held, np.cumsum([0, *size[:-1]]).tolist(), strict=True):
                mine = m[at : at + hi - lo]
                top = mine.argmax(0)
                most = mine[top, np.arange(total)]
                new = most > p[i]
                p[i, new], arg[i, new] = most[new], lo + top[new]
            held.clear()

        room = WORDS
        for i, r in enumerate(rows.tolist()):
            for lo in range(int(first[r]), int(first[r + 1]), WORDS):
                hi = min(lo + WORDS, int(first[r + 1]))
                if held and hi - lo > room:
                    finish()
                    room = WORDS
                held.append((i, lo, hi, min(hi + behind, int(first[r + 1]))))
                room -= hi - lo
        if held:
            finish()
        return p, arg

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        docs = len(offs) - 1
        if self.constant is not None:
            return np.full(docs, self.constant)
        p = np.zeros((docs, len(self.out)), np.float32)
        behind, none = max(self.kernels) - 1, np.zeros((0, 3), np.uint16)
        tail = none
        for a, b, lo, hi in tk.parts(data, offs, tk.ALNUM, PART):
            if b == a + 1 and hi - lo < offs[b] - offs[a]:
                # A part of a long text: windows that begin in its last words are looked at with what follows.
                w = tk.words(tk.FOLD[data[lo:hi]], np.array([0, hi - lo]), tk.ALNUM)
                x = np.concatenate([tail, self.buckets(w)])
                last = hi == offs[b]
                tail = none if last else x[max(0, len(x) - behind) :]
                take = len(x) if last else max(0, len(x) - behind)
                if take:
                    np.maximum(p[a], self.maps(self.vectors(x), np.zeros(len(x), np.int64))[:take].max(0), out=p[a])
            else:
                w = tk.words(tk.FOLD[data[lo:hi]], offs[a : b + 1] - lo, tk.ALNUM)
                p[a:b] = self.pooled(self.vectors(self.buckets(w)), w.first)
        return self.judged(p)

    def judged(self, p: np.ndarray) -> np.ndarray:
        """Scores of pooled responses."""
        return 1 / (1 + np.exp(-np.clip((p @ self.out).astype(np.float64) + self.shift, -30, 30)))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words, and the first word of each document (n + 1); taken by slices, as only these are held of all words."""
    found, counts = [np.zeros((0, 3), np.uint16)], np.zeros(len(offs) - 1, np.int64)
    for a, b, lo, hi in tk.parts(data, offs, tk.ALNUM):
        whole = b > a + 1 or hi - lo == offs[b] - offs[a]
        w = tk.words(tk.FOLD[data[lo:hi]], offs[a : b + 1] - lo if whole else np.array([0, hi - lo]), tk.ALNUM)
        found.append(ConvText.buckets(w))
        counts[a:b] += np.diff(w.first)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> ConvText:
    return trained(*features(*tk.buffers(pa.array(texts, pa.large_string()))), np.arange(len(y)), y, seed)


def trained(b: np.ndarray, first: np.ndarray, rows: np.ndarray, y: np.ndarray, seed: int = 7) -> ConvText:
    """Learn from these rows of the features, whose labels are y, EPOCHS times or STEPS groups of them."""
    model, rng = begun(counted(b, first, rows, y), int((y > 0.5).sum()), len(y), seed), np.random.default_rng(seed + 1)
    if model.constant is None:
        acc, epochs = fresh(model), max(EPOCHS, -(-STEPS * GROUP // len(y)))
        for epoch in range(epochs):
            go_on(model, acc, b, first, rows, y, RATE * (1 - epoch / (epochs + 1)), rng)
    return model


def counted(b: np.ndarray, first: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of these rows of each class have a word in each bucket: 3 x 2 x BUCKETS."""
    pos, seen = y > 0.5, np.zeros((3, 2, BUCKETS))
    for i in range(0, len(rows), 64):
        some = rows[i : i + 64]
        where = np.concatenate([np.arange(first[r], first[r + 1]) for r in some])
        doc = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
        for t in range(3):
            pair = np.unique(doc * BUCKETS + b[where, t])
            for c in (0, 1):
                seen[t, c] += np.bincount((pair % BUCKETS)[pos[i + pair // BUCKETS] == c], minlength=BUCKETS)
    return seen


def begun(seen: np.ndarray, pos: int, n: int, seed: int = 7) -> ConvText:
    """A model whose embeddings begin at each bucket's class log odds, of pos positives among n rows."""
    model, rng = ConvText(), np.random.default_rng(seed)
    if not 0 < pos < n:
        model.constant = pos / n if n else 0.0
        return model
    for down, up in seen:
        odds = np.log((up + 0.3) / (pos + 0.6)) - np.log((down + 0.3) / (n - pos + 0.6))
        odds[up + down == 0] = 0
        table = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
        table[:, 0] = np.clip(odds * np.minimum(1, (up + down) / 4), -3, 3) / 2
        model.tables.append(table)
    inputs = 3 * WIDTH
    for k, f in FILTERS.items():
        kern = rng.normal(0, 0.1, (k, inputs, f)).astype(np.float32)
        kern[:, [0, WIDTH, 2 * WIDTH], :] += (np.linspace(-0.4, 1, f)[None, None, :] / k).astype(np.float32)
        model.kernels[k], model.bias[k] = kern, np.zeros(f, np.float32)
    model.out = np.concatenate([np.linspace(-0.2, 0.5, f) for f in FILTERS.values()]).astype(np.float32)
    model.shift = float(np.log(pos / (n - pos))) - 1.0
    return model


def fresh(model: ConvText) -> dict:
    """Sums of squared gradients before the first: of tables (t), the output (o), its shift (s) and kernels by width."""
    acc = {"t": [np.full((BUCKETS, 1), 1e-2, np.float32) for _ in range(3)], "o": np.full(len(model.out), 1e-2, np.float32), "s": 1e-2}
    return acc | {k: np.full(v.shape, 1e-2, np.float32) for k, v in model.kernels.items()}


RATE = 0.08


def go_on(model: ConvText, acc: dict, b: np.ndarray, first: np.ndarray, rows: np.ndarray, y: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """Once over these rows: Adagrad on the log loss, where only what a pooled maximum came from is updated."""
    for group in np.array_split(rng.permutation(len(y)), max(1, len(y) // GROUP)):
        mine = rows[group]
        p, arg = model.maxima(b, first, mine)
        drop = (rng.random(p.shape) > 0.2).astype(np.float32) / 0.8
        z = (p * drop) @ model.out + model.shift
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[group]) / len(group)).astype(np.float32)
        dp = g[:, None] * (model.out * drop) * (p > 0)
        do = (p * drop).T @ g + 1e-4 * model.out
        acc["o"] += do**2
        acc["s"] += float(g.sum()) ** 2
        model.out -= (rate * do / np.sqrt(acc["o"])).astype(np.float32)
        model.shift -= rate * float(g.sum()) / np.sqrt(acc["s"])
        at, src, grads = 0, [], []
        for k, kern in model.kernels.items():
            f = kern.shape[2]
            d = dp[:, at : at + f]
            dk = np.zeros_like(kern)
            i, q = np.nonzero(d)
            begin, v, end = arg[i, at + q], d[i, q], first[mine + 1][i]
            for j in range(k):
                ok = np.flatnonzero(begin + j < end)
                src.append(begin[ok] + j)
                each = np.zeros((len(ok), f), np.float32)
                each[np.arange(len(ok)), q[ok]] = v[ok]
                dk[j] = model.vectors(b[src[-1]]).T @ each
                grads.append(each @ kern[j].T)
            model.bias[k] -= rate * 0.3 * d.sum(0)
            acc[k] += dk**2
            kern -= rate * dk / np.sqrt(acc[k])
            at += f
        hit, dx = b[np.concatenate(src)], np.concatenate(grads)
        for t in range(3):
            ids, back = np.unique(hit[:, t], return_inverse=True)
            grad = np.zeros((len(ids), WIDTH), np.float32)
            np.add.at(grad, back, dx[:, t * WIDTH : (t + 1) * WIDTH])
            acc["t"][t][ids] += (grad**2).mean(1, keepdims=True)
            model.tables[t][ids] -= rate * grad / np.sqrt(acc["t"][t][ids])


def _flat(model: ConvText, acc: dict) -> np.ndarray:
    """All numbers of the model and then of its sums, one after another."""
    parts = [*model.tables, *model.kernels.values(), *model.bias.values(), model.out, [model.shift], *acc["t"], acc["o"], [acc["s"]], *(acc[k] for k in model.kernels)]
    return np.concatenate([np.ravel(x) for x in parts]).astype(np.float32)


def _unflat(v: np.ndarray) -> tuple[ConvText, dict | None]:
    """What _flat was made of; without the sums where v ends with the model."""
    inputs, total, at = 3 * WIDTH, sum(FILTERS.values()), 0

    def some(*shape: int) -> np.ndarray:
        nonlocal at
        at += math.prod(shape)
        return v[at - math.prod(shape) : at].reshape(shape).copy()

    model = ConvText([some(BUCKETS, WIDTH) for _ in range(3)], {k: some(k, inputs, f) for k, f in FILTERS.items()}, {k: some(f) for k, f in FILTERS.items()}, some(total), float(some(1)[0]))
    if at == len(v):
        return model, None
    acc = {"t": [some(BUCKETS, 1) for _ in range(3)], "o": some(total), "s": float(some(1)[0])}
    return model, acc | {k: some(k, inputs, f) for k, f in FILTERS.items()}


def platt(score: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and shift of the logit that fit held-back labels best (Newton's method, slightly regularised); y positives among n rows of each score."""
    z = np.log(np.clip(score, 1e-9, 1 - 1e-9) / np.clip(1 - score, 1e-9, 1))
    a, c = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        v = n * p * (1 - p)
        grad = np.array([((n * p - y) * z).sum() + 0.5 * (a - 1), (n * p - y).sum() + 0.05 * c])
        hess = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 0.05]])
        step = np.linalg.solve(hess, grad)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    return float(np.clip(a, 0.2, 5)), float(c)


def calibrate(score: np.ndarray, y: np.ndarray, lang: list[str | None], least: int = 20, n: np.ndarray | None = None) -> dict[str, float]:
    """By language, the threshold of the best F1 on held-back rows (y positives among n of each score); "" is for languages with under `least` positives."""
    n = np.ones(len(score)) if n is None else n

    def best(s: np.ndarray, t: np.ndarray, m: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.cumsum(m[order]) + t.sum())
        at = int(f1.argmax())
        under = s[order[at + 1]] if at + 1 < len(s) else 0.0
        return float(np.clip((s[order[at]] + under) / 2, 0.05, 0.95))

    out = {"": best(score, y, n) if y.sum() else 0.5}
    names = np.array([str(x) for x in lang], object)
    for name in sorted({str(x) for x in lang if x is not None}):
        mine = names == name
        if y[mine].sum() >= least:
            out[name] = best(score[mine], y[mine], n[mine])
    return out


def fit(documents: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> ConvText:
    """Fit on all labelled texts of rows where learn_from holds, in one task up to max_rows of at most max_bytes and else in parts.

    A fifth of them is held back from a first fit to calibrate the thresholds; the model returned is fitted on all.
    """
    has_lang = lang_col is not None and lang_col in documents.columns
    lang = [F.col(lang_col).alias("lang")] if has_lang else []
    lab = labels.where(learn_from).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *lang)
    lab = lab.where(F.col("id").isNotNull() & F.col("y").isNotNull()).select("id", F.col("y").cast("float").alias("y")).distinct()
    side = F.broadcast(lab) if lab.count() <= FEW else lab.hint("merge")
    joined = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(side, "id").withColumn("rank", F.xxhash64("id", "text")).drop("id")
    with scratch(documents.sparkSession):
        rows = materialise(joined, "labelled")
        n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
        if not n:
            return fit_rows([], np.zeros(0, np.float32), np.zeros(0, bool), [])
        if n > max_rows or size > max_bytes:
            parts = max(-(-n // (PART_ROWS * max_rows)), -(-size // max_bytes), min(PARTS, -(-n // max_rows)))
            return _fit_parts(rows if has_lang else rows.withColumn("lang", F.lit(None).cast("string")), int(parts))
        return _fit_one(rows, has_lang)


def _fit_one(rows: DataFrame, has_lang: bool) -> ConvText:
    """The model of rows (text, y, rank, lang), learnt in one task."""

    def learn(t: pa.Table) -> ConvText:
        names = t.column("lang").to_pylist() if has_lang else [None] * len(t)
        y, held = t.column("y").to_numpy().astype(np.float32), t.column("rank").to_numpy() % 5 == 0
        b, first = features(*tk.buffers(t.column("text").cast(pa.large_string()).combine_chunks()))
        return _calibrated(b, first, y, held, names)

    return fitted(rows, learn)


def fit_rows(texts: list[str], y: np.ndarray, held: np.ndarray, lang: list[str | None]) -> ConvText:
    """Fit on rows that are here; held marks those that calibrate."""
    return _calibrated(*features(*tk.buffers(pa.array(texts, pa.large_string()))), y, held, lang)


def _calibrated(b: np.ndarray, first: np.ndarray, y: np.ndarray, held: np.ndarray, lang: list[str | None]) -> ConvText:
    every = np.arange(len(y))
    model = trained(b, first, every, y)
    before = trained(b, first, every[~held], y[~held]) if held.any() else model
    if not held.any():
        model.thresholds = {"": 0.5}
        return model
    return _finished(model, before, _judged(before, b, first, every[held]), y[held], [name for name, x in zip(lang, held, strict=True) if x], np.ones(int(held.sum())))


def _judged(model: ConvText, b: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of these rows of the features."""
    return np.full(len(rows), model.constant) if model.constant is not None else model.judged(model.maxima(b, first, rows)[0])


def _finished(model: ConvText, before: ConvText, score: np.ndarray, y: np.ndarray, lang: list[str | None], n: np.ndarray) -> ConvText:
    """model with slope, shift and thresholds by held-back rows: y positives among n for each of before's scores."""
    a, c = platt(score, y, n) if 0 < y.sum() < n.sum() else (1.0, 0.0)
    if model.constant is None and before.constant is None:
        model.out, model.shift = model.out * np.float32(a), model.shift * a + c
        score = 1 / (1 + np.exp(-(np.log(score / (1 - score)) * a + c)))
    model.thresholds = calibrate(score, y, lang, n=n)
    return model


def _fit_parts(rows: DataFrame, parts: int) -> ConvText:
    """The model of rows (text, y, rank, lang), learnt from all of them in so many parts.

    Two models are learnt, of all rows (0) and without those held back (1). Their numbers are a table of rows (k, v) in
    the shared folder, which every part is dealt with its texts; k is the model's number times BIG and where v begins.
    """
    dealt = rows.select(F.pmod(F.xxhash64("rank"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("int").alias("k"), "rank", "text", "y", F.col("lang").cast("string").alias("lang"), F.lit(None).cast("binary").alias("v"))
    up = (F.col("y") > 0.5) & ~F.isnan("y")
    sizes = []
    for some in (F.lit(True), F.col("rank") % 5 != 0):
        sizes += [F.count(F.when(some & up, 1)), F.count(F.when(some, 1))]
    sizes = [int(x) for x in rows.agg(*sizes).first()]
    of = [(sizes[0], sizes[1]), (sizes[2], sizes[3])]
    live = [i for i, (pos, n) in enumerate(of) if 0 < pos < n]

    def each(make: Callable[..., Iterator[pa.RecordBatch]], schema: str, state: DataFrame | None = None) -> DataFrame:
        """What make yields of each part's number, state by model, features, labels, what is held back and languages, as a table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, given, ranks, ys, names, found, counts = 0, {}, [], [], [], [np.zeros((0, 3), np.uint16)], [np.zeros(1, np.int64)]
            for batch in batches:
                if batch.num_rows:
                    number, k = batch.column(0)[0].as_py(), batch.column(1)
                    ahead = len(k) - k.null_count
                    for i in range(ahead):
                        given.setdefault(k[i].as_py() // BIG, []).append(batch.column(6)[i].as_py())
                    batch = batch.slice(ahead)
                    b, first = features(*tk.buffers(batch.column(3)))
                    ranks.append(batch.column(2).to_numpy(zero_copy_only=False))
                    ys.append(batch.column(4).to_numpy(zero_copy_only=False))
                    names += batch.column(5).to_pylist()
                    found.append(b)
                    counts.append(np.diff(first))
            if len(found) > 1:
                b = np.concatenate(found)
                found.clear()
                given = {i: b"".join(v) for i, v in given.items()}
                yield from make(number, given, b, np.cumsum(np.concatenate(counts)), np.concatenate(ys), np.concatenate(ranks) % 5 == 0, names)
            pa.default_memory_pool().release_unused()

        all_rows = dealt
        if state is not None:
            all_rows = dealt.unionByName(state.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), allowMissingColumns=True).select(dealt.columns)
        spread = all_rows.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("k").asc_nulls_last(), "rank", "text", "y", "lang")
        return materialise(spread.mapInArrow(run, schema), "learnt")

    def added(learn: Callable[..., tuple[list[np.ndarray], list[np.ndarray]]], state: DataFrame | None = None) -> DataFrame:
        """The next state: what learn says was before plus the sum of what it makes of the parts, or if there is a before, of each number the mean of the parts where it isn't 0."""

        def make(number: int, *part) -> Iterator[pa.RecordBatch]:
            before, out = learn(number, *part)
            # All parts have begun with the same numbers: one of them passes these on, as part -1.
            for by, models in ((number, out), (-1, before if number == 0 else [])):
                for i, x in enumerate(models):
                    for at in range(0, len(x), SENT):
                        yield pa.RecordBatch.from_arrays([pa.array([i * BIG + at], pa.int32()), pa.array([by], pa.int32()), pa.array([x[at : at + SENT].astype(np.float32).tobytes()], pa.binary())], names=["k", "part", "v"])

        def add(t: pa.Table) -> pa.Table:
            old, total, times = None, 0, 0
            t = t.sort_by("part")
            for by, v in zip(t.column("part").to_pylist(), t.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer(), np.float32)
                if by < 0:
                    old = x
                else:
                    total, times = total + x.astype(np.float64), times + (x != 0)
            new = total if old is None else old + np.asarray(total / np.maximum(1, times), np.float32)
            return pa.table({"k": pa.array([t.column("k")[0].as_py()], pa.int32()), "v": pa.array([new.tobytes()], pa.binary())})

        with scratch(rows.sparkSession):
            learnt = each(make, "k int, part int, v binary", state)
            return materialise(learnt.repartition(ADDERS, "k").groupBy("k").applyInArrow(add, "k int, v binary"), "state", keep=True)

    def count(_, given, b, first, y, held, names) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [], [counted(b, first, take, y[take]).ravel() for take in [np.flatnonzero(~held) if i else np.arange(len(y)) for i in live]]

    state = added(count) if live else None
    for turn in range(ROUNDS if live else 0):

        def learn(number, given, b, first, y, held, names, turn=turn) -> tuple[list[np.ndarray], list[np.ndarray]]:
            before, out = [], []
            for i in live:
                if turn:
                    model, acc = _unflat(np.frombuffer(given.pop(i), np.float32))
                else:
                    model = begun(np.frombuffer(given.pop(i), np.float64).reshape(3, 2, BUCKETS), *of[i])
                    acc = fresh(model)
                before.append(_flat(model, acc))
                take = np.flatnonzero(~held) if i else np.arange(len(y))
                if len(take):
                    go_on(model, acc, b, first, take, y[take], RATE * (1 - turn / (ROUNDS + 1)), np.random.default_rng([turn, number]))
                out.append(_flat(model, acc) - before[-1])
            return before, out

        state = added(learn, state)
    judging = 1 in live

    def held_back(_, given, b, first, y, held, names) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(held)
        before = _unflat(np.frombuffer(given.pop(1), np.float32))[0] if judging else begun(np.zeros(0), *of[1])
        s = np.clip(_judged(before, b, first, at), 1e-13, 1 - 1e-13)
        step = np.round(np.log(s / (1 - s)) * FINE).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at.tolist()], pa.string()), pa.array(step), pa.array(y[at].astype(np.float64))], names=["lang", "step", "y"])

    told = each(held_back, "lang string, step int, y double", state.where(F.col("k") >= BIG) if judging else None)
    told = told.groupBy("lang", "step").agg(F.sum("y").alias("y"), F.count("y").cast("double").alias("n")).orderBy("step", "lang").toArrow()
    if live:
        last = state.where(F.col("k") < MODEL).toArrow().sort_by("k")
        model = _unflat(np.frombuffer(b"".join(v.as_buffer() for v in last.column("v")), np.float32)[:MODEL])[0]
    else:
        model = begun(np.zeros(0), *of[0])
    if not len(told):
        model.thresholds = {"": 0.5}
        return model
    before = ConvText() if judging else begun(np.zeros(0), *of[1])
    score = 1 / (1 + np.exp(-told.column("step").to_numpy() / FINE))
    return _finished(model, before, score, told.column("y").to_numpy(), told.column("lang").to_pylist(), told.column("n").to_numpy())


def score(documents: DataFrame, model: ConvText, text_col: str = "text", lang_col: str | None = "lang", score_col: str = "score", toxic_col: str = "toxic") -> DataFrame:
    """documents with the score of each whole text, and whether it reaches its language's threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in documents.columns if c.lower() != score_col.lower()]
    base = documents.select(*[F.col(f"`{c}`") for c in keep])
    text_at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.scores(*tk.buffers(batch.column(text_at))), pa.float64())], names=[*batch.schema.names, score_col])

    schema = plus(base, **{score_col: "double"})
    scored = base.mapInArrow(run, schema)
    limit = F.lit(model.thresholds.get("", 0.5))
    if lang_col and lang_col in keep:
        for name, value in model.thresholds.items():
            if name:
                limit = F.when(F.col(lang_col) == name, value).otherwise(limit)
    return with_columns(scored, **{toxic_col: F.col(score_col) >= limit})
