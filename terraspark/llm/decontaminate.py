"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against windows of training tokens.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased. A window is `n` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. A training window whose hash is in the set is
verified word by word. Its words are hit; spans of hit words, or documents that have any, can be removed.

The set is broadcast in blocks of about MAX_WINDOWS windows or MAX_BYTES at most, whose size is checked, as flat arrays; the documents pass over one
block after another, and what each found is carried along, so no benchmark is too large.

Defined cases: a null or empty text, or one without words, has no words and no hits. Benchmark rows with equal item_id
are one item; a row without an item_id still hits words but is no item. Repeated document rows are scanned each.
Columns that clash with an output's name are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import materialise, plus

N = 10
MAX_WINDOWS = 1_000_000
#: Bytes of the texts and numbers of the windows that are broadcast at a time, and of a window's numbers.
MAX_BYTES, WINDOW_BYTES = 64 << 20, 20
_SLOTS = 1 << 20
_SPANS = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64()), ("item", pa.string())]))


@dataclass
class Sized:
    """Windows of one length, sorted by hash: their texts in one blob, and the number of each one's item, -1 for none."""

    hashes: np.ndarray
    maybe: np.ndarray
    offsets: np.ndarray
    blob: bytes
    items: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, texts: pa.BinaryArray, items: np.ndarray) -> Sized:
        order = np.argsort(hashes, kind="stable")
        texts = texts.take(pa.array(order))
        maybe = np.zeros(_SLOTS, bool)
        maybe[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        data, offs = tk.buffers(texts)
        return cls(hashes[order], maybe, offs, data.tobytes(), items[order])


@dataclass
class Windows:
    """Benchmark windows by their length, in flat arrays: about 20 bytes for each beside its text."""

    sized: dict[int, Sized]
    names: list[str]

    @classmethod
    def of(cls, table: pa.Table) -> Windows:
        """Of a table (size, hash, words, item)."""
        coded = table.column("item").combine_chunks().dictionary_encode()
        items = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        size, hashes = table.column("size").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
        words = table.column("words").combine_chunks()
        sized = {}
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            sized[k] = Sized.of(hashes[at], words.take(pa.array(at)), items[at])
        return cls(sized, coded.dictionary.to_pylist())

    def find(self, w: tk.Words, h: np.ndarray) -> Iterator[tuple[int, int, set[str | None]]]:
        """First word, length and items of each occurrence of a window."""
        for k, s in self.sized.items():
            g = tk.window_hashes(h, k)
            at = np.flatnonzero(s.maybe[(g & np.uint64(_SLOTS - 1)).astype(np.int64)] & tk.windows_inside(w.doc, k))
            low, high = (np.searchsorted(s.hashes, g[at], side) for side in ("left", "right"))
            some = low < high
            for i, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                text = w.text(i, i + k)
                rows = [r for r in range(a, b) if s.blob[s.offsets[r] : s.offsets[r + 1]] == text]
                if rows:
                    yield i, k, {None if s.items[r] < 0 else self.names[s.items[r]] for r in rows}


def windows_of(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct (size, hash, words, item) of all benchmark texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = tk.buffers(batch.column(1))
            out: set[tuple] = set()
            for a, b in tk.slices(offs):
                w = tk.words(tk.FOLD[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], tk.ALNUM)
                h = tk.word_hashes(w)
                for d in range(b - a):
                    i, j = w.first[d], w.first[d + 1]
                    size = min(n, int(j - i))
                    for s, g in enumerate(tk.window_hashes(h[i:j], size).view(np.int64).tolist() if size else []):
                        out.add((size, g, w.text(i + s, i + s + size), ids[a + d]))
            cols = list(zip(*sorted(out, key=str), strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["size", "hash", "words", "item"])

    return items.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, "size long, hash long, words binary, item string").distinct()


def scan(documents: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """documents with n_words, n_hit, hit_spans (array of [first word, words after), n_items and item_ids (sorted as strings), contaminated, and clean_text, which keeps what lies outside hit spans."""
    spark = documents.sparkSession
    windows = materialise(windows_of(items, item_id, item_text, n), "benchmark-windows")
    count, size = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length("words"))).first()
    blocks = max(1, -(-count // max_windows), -(-((size or 0) + WINDOW_BYTES * count) // MAX_BYTES))
    new = {"n_words": "long", "n_hit": "long", "hit_spans": "array<struct<at:bigint,size:bigint>>", "n_items": "long", "item_ids": "array<string>", "contaminated": "boolean", "clean_text": "string"}
    keep = [c for c in documents.columns if c.lower() not in new]
    df = documents.select(*[F.col(f"`{c}`") for c in keep])
    text_at = keep.index(text_col)
    found = "__found"

    def block(k: int) -> pa.Table:
        return (windows.where(F.pmod(F.xxhash64("size", "hash"), F.lit(blocks)) == k) if blocks > 1 else windows).toArrow()

    def runner(index, last: bool, carried: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _scanned(batch, index.value, keep, text_at, found, carried, last)

        return run

    for k in range(blocks):
        last = k == blocks - 1
        index = spark.sparkContext.broadcast(Windows.of(block(k)))
        schema = plus(documents.select(*[F.col(f"`{c}`") for c in keep]), **(new if last else {found: "array<struct<at:bigint,size:bigint,item:string>>"}))
        df = df.mapInArrow(runner(index, last, k > 0), schema)
        if not last:
            df = materialise(df, "scanned")
            index.unpersist()
    return df


def _scanned(batch: pa.RecordBatch, index: Windows, keep: list[str], text_at: int, found: str, carried: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """The batch in parts, with its occurrences: as spans to carry along, or as the outputs."""
    data, offs = tk.buffers(batch.column(text_at))
    for a, b in tk.slices(offs):
        raw = data[offs[a] : offs[b]]
        w = tk.words(tk.FOLD[raw], offs[a : b + 1] - offs[a], tk.ALNUM)
        h = tk.word_hashes(w)
        hits: dict[int, list[tuple[int, int, set]]] = defaultdict(list)
        for i, k, items in index.find(w, h):
            hits[int(w.doc[i])].append((i - int(w.first[w.doc[i]]), k, items))
        if carried:
            for d, spans in enumerate(batch.column(len(keep)).slice(a, b - a).to_pylist()):
                hits[d].extend((s["at"], s["size"], {s["item"]}) for s in spans or [])
        old = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
        if not last:
            each = [[{"at": i, "size": k, "item": x} for i, k, items in hits.get(d, ()) for x in items] for d in range(b - a)]
            yield pa.RecordBatch.from_arrays([*old, pa.array(each, _SPANS)], names=[*keep, found])
            continue
        n_words = np.diff(w.first)
        n_hit, spans, ids, cleaned = np.zeros(b - a, np.int64), [[]] * (b - a), [[]] * (b - a), batch.column(text_at).slice(a, b - a)
        clean: dict[int, str] = {}
        for d in sorted(d for d, x in hits.items() if x):
            first = int(w.first[d])
            mask = tk.cover(int(n_words[d]), np.array([x[0] for x in hits[d]]), np.array([x[1] for x in hits[d]]))
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
            n_hit[d] = mask.sum()
            spans[d] = [{"at": int(s), "size": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
            ids[d] = sorted({x for _, _, items in hits[d] for x in items if x is not None})
            parts, upto = [], int(offs[a + d] - offs[a])
            for s, e in zip(edge[::2], edge[1::2], strict=True):
                parts.append(raw[upto : w.starts[first + s]].tobytes())
                upto = int(w.ends[first + e - 1])
            clean[d] = b"".join([*parts, raw[upto : offs[a + d + 1] - offs[a]].tobytes()]).decode()
        if clean:
            cleaned = pa.array([clean.get(d, t) for d, t in enumerate(cleaned.to_pylist())], pa.string())
        outs = [pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array(spans, pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(n_hit > 0), cleaned.cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*old, *outs], names=[*keep, "n_words", "n_hit", "hit_spans", "n_items", "item_ids", "contaminated", "clean_text"])


def decontaminate(documents: DataFrame, items: DataFrame, text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """documents without contaminated ones (remove="documents") or without the hit spans of their texts ("spans"); columns as they were."""
    held = documents.select(F.col(text_col).alias("__text"), F.struct("*").alias("__row"))
    marked = scan(held, items, "__text", **options)
    if remove == "documents":
        return marked.where(~F.col("contaminated")).select("__row.*")
    return marked.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in documents.columns])
