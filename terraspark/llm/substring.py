"""Substring dedup: recurring passages are confirmed and located by sharded Aho-Corasick automata over words.

Words are what lies between white space, unchanged. A window is `window` consecutive words of a document; windows with
the same words recur. Every word that a recurring window covers is removed.

1. Anchors. A window's anchor is the least hash among its GRAM-word grams (mixed once more, as least hashes are small
   numbers), so equal windows have equal anchors. Anchors
   that occur twice in the corpus are marked in a bitmap of fixed size, those that occur over CROWD times in a second
   one. A false mark costs time only.
2. Pieces. Neighbouring windows with the same marked anchor are one piece of text, or a piece each where the anchor is
   crowded. Each partition writes its distinct pieces with their counts, and which anchors the documents of which shard
   have. Documents are dealt to shards of about SHARD_BYTES by a hash of the whole row, so copies spread out.
3. Passages. Pieces are brought together by anchor (crowded ones by their own hash) and their windows counted word by
   word. Runs of recurring windows are the confirmed passages of an anchor, cut to at most LONGEST words so that every
   window stays whole in one of them.
4. Automata. Each shard gets the passages of its documents' anchors, compiles one automaton of them, and streams all its
   documents, whole, through it. The words of every occurrence that it locates go. Nothing else says where they are.

Defined cases: null, empty and blank texts have no words; texts shorter than a window lose nothing. Repeated rows are
documents each, so all their windows recur; rows that are equal in every column are one shard's work. A text of over
PART bytes is streamed in parts, its located words carried over their borders. Other columns stay; n_words, n_removed and text are set by the operator
(text: the kept words, one space between).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import materialise, new_path, plus, remove, scratch, with_columns

WINDOW, GRAM = 35, 8
BITS = 28
CROWD = 2000
SHARD = 4000
#: Distinct pieces, and pairs of anchor and shard, that a task holds before it writes them.
HELD, PAIRS = 40_000, 500_000
#: Bytes of text that one automaton serves, about; words of a passage; bytes of text that are streamed at once.
SHARD_BYTES, LONGEST, PART = 4 << 20, 128, 1 << 20
#: Bits of a letter of an automaton.
BASE = 8
#: Partitions that shards are dealt to; where there are more shards, a partition takes several, one after another.
MOST_PARTITIONS = 10_000


def sliding(x: np.ndarray, k: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every k consecutive values, by doubling."""
    if len(x) < k:
        return x[:0]
    n = 1
    while 2 * n <= k:
        x = best(x[: len(x) - n], x[n:])
        n *= 2
    return best(x[: len(x) - (k - n)], x[k - n :]) if n < k else x


def window_anchors(w: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, and of every window start its anchor and whether the window lies inside one document."""
    g = tk.window_hashes(tk.word_hashes(w), GRAM)
    return g, sliding(g, window - GRAM + 1, np.minimum), tk.windows_inside(w.doc, window)


def anchors(documents: DataFrame, window: int) -> DataFrame:
    """(anchor, n) of a text column: how often each anchor is the least gram of some window, counted by batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(0))
            found = []
            for a, b in tk.slices(offs):
                w = tk.words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], tk.NOT_SPACE)
                g, m, inside = window_anchors(w, window)
                if inside.any():
                    width = window - GRAM + 1
                    edge = np.zeros(width - 1, np.uint64)
                    found.append(g[sliding(np.concatenate([edge, np.where(inside, m, 0).astype(np.uint64), edge]), width, np.maximum) == g])
            h, n = np.unique(tk.mix(np.concatenate(found)), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return documents.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame, bits: int = BITS) -> Broadcast:
    """A broadcast bitmap of 2**bits bits of (anchor long). Each of its 256 chunks is filled by one task as rows stream by."""
    size = (1 << bits) // 8 // 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(size * 8, bool))
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for k in np.unique(at // (size * 8)).tolist():
                mine = at[at // (size * 8) == k]
                parts[k][(mine % (size * 8)).astype(np.int64)] = True
        for k, v in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(v).tobytes()], pa.binary())], names=["k", "bits"])

    out = np.zeros((256, size), np.uint8)
    for r in hashes.repartition(64, F.shiftrightunsigned("anchor", 56)).mapInArrow(run, "k long, bits binary").collect():
        out[r["k"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out.ravel())


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(bits) * 8 - 1).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def pieces(documents: DataFrame, twice: Broadcast, crowded: Broadcast, window: int) -> DataFrame:
    """From (shard, text): rows of distinct pieces (deal, text, n) and of what a shard's documents have (deal, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        seen: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                n, v = len(held), list(held.values())
                cols = [pa.array([x[0] for x in v], pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(held), pa.binary()), pa.array([x[1] for x in v], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=NAMES)
                held.clear()

        def pairs() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if seen:
                both = np.unique(np.concatenate(seen), axis=0)
                seen.clear()
                size, n = 0, len(both)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=NAMES)

        for batch in batches:
            shard = batch.column(0).to_numpy()
            data, offs = tk.buffers(batch.column(1))
            for a, b in tk.slices(offs):
                w = tk.words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], tk.NOT_SPACE)
                _, m, inside = window_anchors(w, window)
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                m = tk.mix(m)
                at = at[marked(twice.value, m[at])]
                hot = marked(crowded.value, m[at])
                new = np.ones(len(at), bool)
                new[1:] = hot[1:] | (at[1:] != at[:-1] + 1) | (m[at[1:]] != m[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(at)]]) - 1 if len(first) else first
                deal = np.where(hot[first], tk.mix(tk.window_hashes(tk.word_hashes(w), window)[at[first]]), m[at[first]]).view(np.int64)
                for s, e, d in zip(at[first].tolist(), at[last].tolist(), deal.tolist(), strict=True):
                    text = w.text(s, e + window)
                    if text in held:
                        held[text][1] += 1
                    else:
                        held[text] = [d, 1]
                if len(first):
                    seen.append(np.unique(np.stack([deal, shard[a + w.doc[at[first]]]], 1), axis=0))
                    size += len(seen[-1])
                if len(held) > HELD:
                    yield from flush()
                if size > PAIRS:
                    yield from pairs()
        yield from flush()
        yield from pairs()

    return documents.mapInArrow(run, "deal long, shard long, text binary, n long")


NAMES = ["deal", "shard", "text", "n"]


def recurring(texts: list[bytes], counts: list[int], window: int) -> list[list[bytes]]:
    """Of distinct pieces with their counts, the passages of each: runs of windows that occur more than once, in parts of at most LONGEST words."""
    number: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    ids = [np.array([number.setdefault(x, len(number)) for x in w], np.int32) for w in words]
    seen: dict[bytes, int] = defaultdict(int)
    windows = [[x[i : i + window].tobytes() for i in range(len(x) - window + 1)] for x in ids]
    for keys, n in zip(windows, counts, strict=True):
        for k in keys:
            seen[k] += n
    out, longest = [], max(LONGEST, 2 * window)
    for w, keys in zip(words, windows, strict=True):
        again = np.array([seen[k] > 1 for k in keys], bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]])))
        mine = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            for i in range(a, b, longest - window + 1):
                mine.append(b" ".join(w[i : min(i + longest, b + window - 1)]))
        out.append(mine)
    return out


def passages(found: DataFrame, window: int, shard: int = SHARD) -> DataFrame:
    """(deal, passage) of pieces (deal, text, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        deal = None

        def finish() -> Iterator[pa.RecordBatch]:
            made = recurring(list(held), [v[1] for v in held.values()], window)
            rows = list({(v[0], p) for v, mine in zip(held.values(), made, strict=True) for p in mine})
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["deal", "passage"])

        for batch in batches:
            for d, text, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if d != deal:
                    deal = d
                    if len(held) >= shard:
                        yield from finish()
                held.setdefault(text, [d, 0])[1] += n
        yield from finish()

    return found.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "deal long, passage binary")


class Locator:
    """An automaton over the words of passages.

    A word is written as the digits of its number, the letters of the automaton, since it looks for a state's next
    letter among all that follow it. Each place has digits of its own, so that no match begins within a word.
    """

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}  # from 1; 0 is for all words that no passage has
        self.known: list[list[int]] = []
        self.automaton, self.longest, self.places = None, 1, 1

    def add(self, passage: bytes) -> None:
        number = self.number
        self.known.append([number.setdefault(x, len(number) + 1) for x in passage.split()])

    def _letters(self, n: np.ndarray) -> list[int]:
        return np.stack([(n >> (BASE * k) & ((1 << BASE) - 1)) + (k << BASE) for k in range(self.places)], 1).ravel().tolist()

    def _compile(self) -> None:
        self.places = max(1, -(-len(self.number).bit_length() // BASE))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i in range(0, len(self.known), 1000):
            some = self.known[i : i + 1000]
            letters, at = self._letters(np.array([n for p in some for n in p], np.int64)), 0
            for p in some:
                self.automaton.add_word(tuple(letters[at : at + len(p) * self.places]), len(p))
                at += len(p) * self.places
        self.longest = max(map(len, self.known))
        self.known.clear()
        self.automaton.make_automaton()

    def spans(self, raw: bytes) -> tuple[int, np.ndarray]:
        """Number of words of the text, and (first word, words) of every occurrence of a passage in it."""
        if self.known and self.automaton is None:
            self._compile()
        out, begin, tail = [], 0, []
        for part in _parts(raw):
            words = part.split()
            if self.automaton is not None:
                back, whole = begin - len(tail), tail + words
                numbers = np.fromiter(map(self.number.get, whole, repeat(0)), np.int64, len(whole))
                found = [(back + (end + 1) // self.places - size, size) for end, size in self.automaton.iter(tuple(self._letters(numbers)))]
                if found:
                    out.append(np.array(found, np.int64))
                tail = whole[max(0, len(whole) - self.longest + 1) :]
            begin += len(words)
        return begin, np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _parts(raw: bytes) -> Iterator[bytes]:
    """The text in parts of about PART bytes, cut between words."""
    if len(raw) <= PART:
        yield raw
        return
    data = np.frombuffer(raw, np.uint8)
    for _, _, lo, hi in tk.parts(data, np.array([0, len(raw)]), tk.NOT_SPACE, PART):
        yield raw[lo:hi]


def _without(raw: bytes, mask: np.ndarray | None) -> str:
    """The words that aren't masked, one space between."""
    kept, at = [], 0
    for part in _parts(raw):
        words = part.split()
        if mask is not None:
            here = mask[at : at + len(words)].tolist()
            at += len(words)
            words = [w for w, gone in zip(words, here, strict=True) if not gone]
        if words:
            kept.append(b" ".join(words))
    return b" ".join(kept).decode()


def located(rows: DataFrame, text_col: str) -> DataFrame:
    """From (shard, kind, passage, all), a shard's passages (kind 0) before its documents: all, the kept words, and how many there were and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, locator = None, Locator()
        for batch in batches:
            every = batch.column(3)
            docs = np.flatnonzero(batch.column(1).to_numpy())
            texts = pc.struct_field(every, [text_col]).cast(pa.large_binary())
            kept, total, gone = [], [], []
            for s, kind, passage, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), range(batch.num_rows), strict=True):
                if s != shard:
                    shard, locator = s, Locator()
                if not kind:
                    locator.add(passage)
                    continue
                raw = texts[i].as_py() or b""
                n, spans = locator.spans(raw)
                mask = tk.cover(n, spans[:, 0], spans[:, 1]) if len(spans) else None
                kept.append(_without(raw, mask))
                total.append(n)
                gone.append(0 if mask is None else int(mask.sum()))
            if len(docs):
                yield pa.RecordBatch.from_arrays([every.take(pa.array(docs)), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["__all", "__kept", "__n", "__gone"])

    return rows.mapInArrow(run, plus(rows.select("__all"), __kept="string", __n="long", __gone="long"))


def dedup_passages(documents: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """documents with text (kept words, one space between), n_words and n_removed."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    with scratch(spark):
        counted = materialise(anchors(documents.select(text.alias("text")), window).where("n > 1"), "anchors")
        twice, crowded = bitmap(counted.select("anchor")), bitmap(counted.where(F.col("n") > CROWD).select("anchor"))
    shards = (documents.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES + 1
    hashed = [F.col(f"`{f.name}`") for f in documents.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    shard = F.pmod(F.xxhash64(*hashed), F.lit(shards))
    path = new_path(spark, "pieces")
    pieces(documents.select(shard.alias("shard"), text.alias("text")), twice, crowded, window).withColumn("need", F.col("shard").isNotNull()).write.partitionBy("need").parquet(path)
    rows = spark.read.schema("deal long, shard long, text binary, n long, need boolean").parquet(path)
    confirmed = materialise(passages(rows.where("NOT need").select("deal", "text", "n"), window), "passages")
    remove(spark, f"{path}/need=false")
    # What is left of the table is listed anew.
    left = spark.read.schema("deal long, shard long, need boolean").parquet(path)
    wanted = left.where("need").select("deal", "shard").distinct().join(confirmed.hint("merge"), "deal")
    whole = documents.select(shard.alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("passage"), F.struct("*").alias("__all"))
    none = F.lit(None).cast(whole.schema["__all"].dataType)
    both = wanted.select("shard", F.lit(0).alias("kind"), "passage", none.alias("__all")).unionByName(whole)
    partitions = min(shards, MOST_PARTITIONS)
    dealt = both.repartitionById(partitions, F.pmod("shard", F.lit(partitions)).cast("int")).sortWithinPartitions("shard", "kind")
    done = located(dealt, text_col)
    flat = done.select(*[F.col("__kept").alias(c) if c == text_col else F.col(f"__all.`{c}`").alias(c) for c in documents.columns], "__n", "__gone")
    return with_columns(flat, n_words=F.col("__n"), n_removed=F.col("__gone")).drop("__n", "__gone")
