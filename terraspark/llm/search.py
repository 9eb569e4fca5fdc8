"""Exact top-k BM25 search over an inverted index in shards, with block-max pruning.

Words are those of the benchmark operator (0-9, a-z after A-Z is lower-cased, and non-ASCII characters); a term is a
word's 64-bit hash. The index is a table of postings by shard and term, packed. Numbers of documents, their mean length and
document frequencies are global. A query is all distinct words of its text; its score for a document is the BM25 sum
(k1, b) over them.

Shards are of one kind of text each (told by its common words, so mostly its language): a query whose bounds (inverse
document frequency times largest impact in the shard) don't sum up to its k-th best so far, which is carried from shard
to shard, passes a shard of another kind by. In the others its short lists are added up. Its long ones (of over one
document in LONG) are ordered by bound; those before the pivot are added, for TOGETHER queries in one product. Those
behind it, whose bounds come to no more than SKIP of the threshold, are left out, and documents are judged by the maxima
of these lists over blocks of BLOCK documents first. What can reach the threshold is scored exactly from the documents'
own term lists. Each task's best are merged.

Queries are broadcast in blocks of bounded size. A shard is read once and asked all blocks in turn.

Defined cases: rows without words are never found and find nothing; scores are above 0. Ties (scores equal to nine
places) go by id, null ids last. Repeated rows are documents each. Null query ids are no queries; rows of
one query id ask together, with the words of all their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import materialise

K1, B = 1.2, 0.75
TOP = 10
#: A shard has about this many documents; one with more than MOST documents or postings is cut.
SHARD_DOCS, MOST_DOCS, MOST_POSTINGS = 16_384, 24_576, 6_000_000
BLOCK = 64
#: Postings of one row of the index.
PACKED = 128
#: Kinds of text are told by so many common words, of about so many texts, and are so many at most.
KIND_TERMS, KIND_TEXTS, KINDS = 512, 2_000, 8
#: A list of over one document in so many is long.
LONG = 8
#: Bytes of the long lists laid out by document, longest first.
LAID_OUT = 24 << 20
#: Queries of a shard in one product with its long lists.
TOGETHER = 64
#: Long lists whose bounds sum up to this part of the threshold are left to the candidates.
SKIP = 0.1
#: Terms of the queries in one broadcast (4 bytes each, and 16 for each distinct one).
QUERY_TERMS = 2_000_000
#: Shards (of SHARD_DOCS documents) of one task, where there are more than this for each core.
TASK_SHARDS = 16


def bags(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of documents, sorted by document and term; and their lengths in words."""
    w = tk.words(tk.FOLD[data], offs, tk.ALNUM)
    h = tk.word_hashes(w)
    order = np.argsort(h)
    order = order[np.argsort(w.doc[order].astype(np.uint16 if len(offs) < 65_536 else np.int64), kind="stable")]
    doc, term = w.doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first].astype(np.int32), term[first], np.diff(np.concatenate([first, [len(doc)]])).astype(np.int32), np.diff(w.first)


@dataclass
class Kinds:
    """Kinds of text (of one language, say) by their common words: terms, sorted, and what each speaks for."""

    terms: np.ndarray
    votes: np.ndarray

    def of(self, doc: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        """The kind of each document."""
        if self.votes.shape[1] < 2:
            return np.zeros(docs, np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[at] == term)
        sums = [np.bincount(doc[here], self.votes[at[here], x], docs) for x in range(self.votes.shape[1])]
        return np.argmax(sums, 0)


def kinds(texts: pa.Array) -> Kinds:
    """Of sample texts: clusters by their commonest words, those that share these being one. Which they are decides only what is searched together."""
    data, offs = tk.buffers(texts)
    doc, term, _, _ = bags(data, offs)
    terms, place, n = np.unique(term, return_inverse=True, return_counts=True)
    common = np.sort(np.argsort(-n, kind="stable")[:KIND_TERMS])
    x = np.zeros((len(texts), len(common)), np.float32)
    column = np.full(len(terms), -1)
    column[common] = np.arange(len(common))
    here = column[place] >= 0
    x[doc[here], column[place[here]]] = 1
    x = x[x.any(1)]
    if not len(x):
        return Kinds(terms, np.zeros((len(terms), 1)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[:1]
    while len(centre) < min(KINDS, len(x)):
        centre = np.concatenate([centre, x[[int(np.argmin((x @ centre.T).max(1)))]]])
    for _ in range(10):
        of = np.argmax(x @ centre.T, 1)
        centre = np.stack([x[of == c].sum(0) if (of == c).any() else centre[c] for c in range(len(centre))])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    like, group = centre @ centre.T > 0.4, np.arange(len(centre))
    for _ in group:
        group = np.array([group[row].min() for row in like])
    of = group[np.argmax(x @ centre.T, 1)]
    votes = np.stack([x[of == g].sum(0) for g in np.unique(of)])
    votes /= np.linalg.norm(votes, axis=1, keepdims=True)
    return Kinds(terms[common], votes.T.astype(float))


def build(documents: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    """The index: of each shard a row about its documents (part 0: their ids, lens, numbers of words and postings), and rows of about PACKED postings: terms (packed int64) and, packed int32, the size of each one's list, and docs and freqs of these."""
    base = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "shard long, part int, words long, postings long, ids array<long>, lens binary, terms binary, sizes binary, docs binary, freqs binary"
    sample = base.sample(min(1.0, KIND_TEXTS / max(1, count)), seed=1) if count > KIND_TEXTS else base
    kind = kinds(sample.select(F.substring("text", 1, 2000).alias("text")).limit(2 * KIND_TEXTS).toArrow().column(0).combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, parts, ids, lens, total = 0, ([], [], [], []), [], [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal made, total
            shard = (TaskContext.get().partitionId() << 20) + made
            made += 1
            size, every, of = np.concatenate(lens).astype(np.int32), np.array(ids, object), np.concatenate(parts[3])
            doc, term, freq = (_whole(x) for x in parts[:3])
            parts[3].clear()
            have, of = np.unique(of, return_inverse=True)
            if len(have) > 1:
                order = np.argsort(of.astype(np.uint8)[doc], kind="stable")
                doc = doc[order]
                term = term[order]
                freq = freq[order]
                del order
            a = 0
            for x, g in enumerate(have.tolist()):
                mine = of == x
                b = a + int(np.searchsorted(of[doc[a:]], x, "right"))
                yield from _rows((g << 48) + shard, every[mine].tolist(), size[mine], (np.cumsum(mine) - 1).astype(np.int32)[doc[a:b]], term[a:b], freq[a:b])
                a = b
            ids.clear()
            lens.clear()
            total = 0

        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            every = batch.column(0).to_pylist()
            for a, b in tk.slices(offs):
                doc, term, freq, size = bags(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if ids and (len(ids) + b - a > MOST_DOCS or total + len(doc) > MOST_POSTINGS):
                    yield from finish()
                for part, x in zip(parts, (doc + np.int32(len(ids)), term, freq, kind.of(doc, term, b - a)), strict=True):
                    part.append(x)
                ids.extend(every[a:b])
                lens.append(size.astype(np.int32))
                total += len(doc)
        if ids:
            yield from finish()
        pa.default_memory_pool().release_unused()

    return base.coalesce(max(1, -(-count // SHARD_DOCS))).mapInArrow(run, schema)


def _whole(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; they are let go."""
    x = np.concatenate(parts)
    parts.clear()
    return x


NAMES = ["shard", "part", "words", "postings", "ids", "lens", "terms", "sizes", "docs", "freqs"]


def _rows(shard: int, ids: list, size: np.ndarray, doc: np.ndarray, term: np.ndarray, freq: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The index rows of a shard of these documents and postings, which come by document."""
    one, blob = lambda x, t: pa.array([x], t), pa.binary()
    yield pa.RecordBatch.from_arrays([one(shard, pa.int64()), one(0, pa.int32()), one(int(size.sum()), pa.int64()), one(len(doc), pa.int64()), one(ids, pa.list_(pa.int64())), one(size.tobytes(), blob), *[pa.nulls(1, blob)] * 4], names=NAMES)
    order = np.argsort(term, kind="stable")
    term, doc, freq = term[order], doc[order], freq[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    edge = np.concatenate([first, [len(term)]])
    sizes, term = np.diff(edge).astype(np.int32), term[first]
    cut = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, len(doc), PACKED)), [len(first)]]))
    for a in range(0, len(cut) - 1, 1000):
        c = cut[a : a + 1001]
        n = len(c) - 1
        blobs = [_blobs(x, at) for x, at in ((term, c), (sizes, c), (doc, edge[c]), (freq, edge[c]))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(a + 1, a + n + 1, dtype=np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, blob), *blobs], names=NAMES)


def _blobs(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """x cut at these places, as binary values."""
    offsets = ((at - at[0]) * x.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x[at[0] : at[-1]]))])


@dataclass
class Shard:
    """Postings by term (sorted), with frequencies; norm is each document's part of the BM25 denominator.

    Impacts are kept in single precision, which only decides what is looked at; scores come from the frequencies. They
    are weighed once for all queries of a block, and its long lists (of over one document in LONG) are laid out by
    document, with maxima of their blocks.
    """

    ids: list[int | None]
    terms: np.ndarray
    edge: np.ndarray
    docs: np.ndarray
    freqs: np.ndarray
    norm: np.ndarray

    def __post_init__(self) -> None:
        n, docs = np.diff(self.edge), len(self.ids)
        self.impact = self.freqs.astype(np.float32)
        for a in range(0, len(self.docs), 1 << 20):
            part = self.impact[a : a + (1 << 20)]
            part *= np.float32(K1 + 1) / (part + self.norm[self.docs[a : a + (1 << 20)]].astype(np.float32))
        self.list_max = np.maximum.reduceat(self.impact, self.edge[:-1]) if len(n) else self.impact[:0]
        if docs < 65_536:
            self.docs = self.docs.astype(np.uint16, copy=False)
        order = np.argsort(self.docs, kind="stable")
        self.own_freq = self.freqs[order]
        del self.freqs
        self.own_term = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        del order
        self.own_edge = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=docs))])
        self.blocks = -(-docs // BLOCK)
        self.weight = np.zeros(len(n))

    def weigh(self, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Make ready for queries of these distinct terms; the place of each here, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        n = np.diff(self.edge)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        self.idf = np.zeros(len(n))
        self.idf[at[here]] = idf[here]
        self.bound = self.idf * self.list_max
        self.part = np.repeat(self.idf.astype(np.float32), n)
        self.part *= self.impact
        long = np.flatnonzero((n > len(self.ids) / LONG) & (self.idf > 0))
        if len(long) > (most := max(1, LAID_OUT // (4 * self.blocks * BLOCK))):
            long = long[np.argsort(-n[long], kind="stable")[:most]]
        self.row = np.full(len(n), -1)
        self.row[long] = np.arange(len(long))
        self.by_doc = np.zeros((len(long), self.blocks * BLOCK), np.float32)
        for r, (a, b) in enumerate(zip(self.edge[long].tolist(), self.edge[long + 1].tolist(), strict=True)):
            self.by_doc[r, self.docs[a:b]] = self.part[a:b]
        self.block_max = self.by_doc.reshape(len(long), self.blocks, BLOCK).max(2)
        return np.where(here, at, -1)

    def _short(self, t: np.ndarray) -> np.ndarray:
        """What the lists of these terms add to the documents' scores."""
        a, n = self.edge[t], self.edge[t + 1] - self.edge[t]
        if n.sum() < 100 * len(t):
            upto = np.cumsum(n)
            p = np.repeat(a - (upto - n), n)
            p += np.arange(len(p))
            docs, part = self.docs[p], self.part[p]
        else:
            ends = list(zip(a.tolist(), (a + n).tolist(), strict=True))
            docs, part = (np.concatenate([x[i:j] for i, j in ends]) if ends else x[:0] for x in (self.docs, self.part))
        return np.bincount(docs, part, self.blocks * BLOCK)

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = 0.0) -> list[tuple[int, float]]:
        """answer() for one query alone."""
        at = self.weigh(terms, idf)
        return [x for _, found, score in self.answer(at, np.array([0, len(at)]), np.array([floor]), k) for x in zip(found.tolist(), score.tolist(), strict=True)]

    def answer(self, at: np.ndarray, edge: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For queries with their terms at these places (at[edge[q] : edge[q + 1]], one at least), (q, documents, scores): the k best of this shard that reach the query's floor; more only where scores tie."""
        if not len(self.terms) or len(edge) < 2:
            return
        total = np.add.reduceat(np.append(self.bound, 0.0)[at], edge[:-1])
        # Sums of impacts are of single precision, thresholds may be exact: whatever they are held against has this slack.
        slack = 1e-6 + (1e-5 + 1e-7 * np.diff(edge)) * (floor + total)
        hope = np.flatnonzero((total > 0) & (total >= floor - slack))
        for a in range(0, len(hope), TOGETHER):
            some = hope[a : a + TOGETHER]
            asked, weights = [], np.zeros((len(some), len(self.by_doc)), np.float32)
            for x, q in enumerate(some.tolist()):
                t = at[edge[q] : edge[q + 1]]
                t = t[t >= 0]
                row = self.row[t]
                long = row >= 0
                rows = row[long]
                later = rows[:0]
                if floor[q] > 100 * slack[q]:
                    # The pivot: the lists of the least bounds that make up for no more than a part of the threshold.
                    bound = self.bound[t[long]]
                    order = np.argsort(bound, kind="stable")
                    i = int(np.searchsorted(np.cumsum(bound[order]), SKIP * floor[q], "right"))
                    rows, later = rows[order[i:]], rows[order[:i]]
                weights[x, rows] = 1
                asked.append((q, t, t[~long], later))
            used = np.flatnonzero(weights.any(0))
            added = weights @ self.by_doc if 2 * len(used) > len(self.by_doc) else weights[:, used] @ self.by_doc[used]
            for x, (q, t, short, later) in enumerate(asked):
                found, score = self._best(t, self._short(short) + added[x], later, k, float(floor[q]), float(slack[q]))
                if len(found):
                    yield q, found, score

    def _best(self, t: np.ndarray, acc: np.ndarray, later: np.ndarray, k: int, floor: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """The best documents of a query of terms t by its scores so far, which lack only the long lists in these rows."""
        n = len(self.ids)
        if len(later):
            # Blocks first: what their maxima cannot lift over the threshold is not looked at.
            need = floor - slack - self.block_max[later].sum(0, dtype=float)
            found = np.flatnonzero((acc.reshape(-1, BLOCK) >= need[:, None]).ravel())
            near = acc[found] + self.by_doc[later[:, None], found].sum(0, dtype=float)
        else:
            found = np.flatnonzero(acc >= (floor - slack if floor or n <= k else np.partition(acc[:n], n - k)[n - k] - 2 * slack))
            near = acc[found]
        keep = (near > 0) & (near >= floor - slack)
        found, near = found[keep], near[keep]
        if len(found) > k:
            found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * slack]
        if not len(found):
            return found, np.zeros(0)
        self.weight[t] = self.idf[t]
        m = self.own_edge[found + 1] - self.own_edge[found]
        p = np.arange(m.sum()) + np.repeat(self.own_edge[found] - (np.cumsum(m) - m), m)
        w = self.weight[self.own_term[p]]
        at = np.flatnonzero(w)
        f = self.own_freq[p[at]].astype(np.float64)
        part = np.zeros(len(p))
        part[at] = w[at] * f * (K1 + 1) / (f + np.repeat(self.norm[found], m)[at])
        exact = np.round(np.add.reduceat(part, np.cumsum(m) - m), 9)
        self.weight[t] = 0
        keep = exact >= floor
        if len(exact) > k:
            keep &= exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
        return found[keep], exact[keep]


def _packed(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers packed in all values of a binary column, one value after another."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if len(column) and data is not None else np.zeros(0, kind)


def _load(batches: list[pa.RecordBatch], mean: float) -> Shard:
    """One shard of the index rows of one or several, which come sorted by shard and part; the batches are let go as they are read."""
    ids, lens, parts, shards, base = [], [], [], 0, 0
    batches.reverse()
    while batches:
        batch = batches.pop()
        if batch.column("part")[0].as_py() == 0:
            base = len(ids)
            shards += 1
            ids.extend(batch.column("ids")[0].as_py())
            lens.append(np.frombuffer(batch.column("lens")[0].as_py(), np.int32).astype(np.float64))
            batch = batch.slice(1)
        if len(batch):
            parts.append((_packed(batch.column("terms"), np.int64), _packed(batch.column("sizes"), np.int32), _packed(batch.column("docs"), np.int32) + np.int32(base), _packed(batch.column("freqs"), np.int32)))
        del batch
    columns = []
    for i in range(4):
        columns.append(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64 if i == 0 else np.int32)]))
        if i > 1 and len(columns[i]) and columns[i].max() < 65_536:
            columns[i] = columns[i].astype(np.uint16)
        parts = [p[1:] for p in parts]
    terms, n, docs, freqs = columns
    columns.clear()
    # Terms come sorted as unsigned, and by shard.
    order = np.argsort(terms, kind="stable")
    kind = np.int32 if len(docs) < 1 << 31 else np.int64
    start = np.cumsum(n, dtype=np.int64) - n
    terms, n, start = terms[order], n[order], start[order]
    edge = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    at = np.repeat((start - edge[:-1]).astype(kind), n)
    at += np.arange(len(at), dtype=kind)
    docs = docs[at]
    freqs = freqs[at]
    del at, order, start
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    return Shard(ids, terms[first], np.append(edge[first], len(docs)), docs, freqs, K1 * (1 - B + B * np.concatenate(lens) / mean))


def _sizes(index: DataFrame) -> DataFrame:
    """(term, n) of the lists of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                some = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([pa.array(_packed(some.column(0), np.int64)), pa.array(_packed(some.column(1), np.int32).astype(np.int64))], names=["term", "n"])

    return index.where("part > 0").select("terms", "sizes").mapInArrow(run, "term long, n long")


def search(documents: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents that score highest for each query (id_col, text_col)."""
    spark = documents.sparkSession
    count = documents.count()
    index = materialise(build(documents, id_col, text_col, count), "search-index")
    total = index.where("part = 0").agg(F.sum(F.size("ids")), F.sum("words"), F.count("shard")).first()
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in (("query_id", "long"), ("doc_id", "long"), ("score", "double"))])
    if not total[0] or not total[1]:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    n, mean, shards = int(total[0]), total[1] / total[0], int(total[2])
    df = _sizes(index).groupBy("term").agg(F.sum("n").alias("df"))
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = asked.groupBy("query_id").agg(F.concat_ws("\n", F.collect_set("text")).alias("text"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = materialise(_terms(asked).join(df.hint("merge"), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms")), "search-queries")
    blocks = max(1, -(-(weighed.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS))
    # A task takes its shards in turn, and what it has found so far is the threshold for the next. There are as many tasks
    # as cores, or more where one would have over TASK_SHARDS shards. A shard is read once and asked all blocks of queries.
    tasks = min(shards, max(1, spark.sparkContext.defaultParallelism, -(-count // (SHARD_DOCS * TASK_SHARDS))))
    dealt = index.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "part")
    asking = []
    for x in range(blocks):
        rows = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == x).select("query_id", "terms.term", "terms.idf").toArrow().combine_chunks()
        if len(rows):
            asking.append(spark.sparkContext.broadcast(_block(rows)))
    best = dealt.mapInArrow(_searcher(asking, k, mean), schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _terms(asked: DataFrame) -> DataFrame:
    """(query_id, term) of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in tk.slices(offs):
                doc, term, _, _ = bags(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + doc]), pa.array(term.view(np.int64))], names=["query_id", "term"])

    return asked.mapInArrow(run, "query_id long, term long")


def _block(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Queries as arrays: their ids, where the terms of each begin, the terms as places among the distinct ones, and these with their weights."""
    every = [rows.column(i).combine_chunks() for i in range(3)]
    edge = np.concatenate([[0], np.cumsum(every[1].value_lengths().to_numpy())]).astype(np.int64)
    terms, first, place = np.unique(every[1].flatten().to_numpy(), return_index=True, return_inverse=True)
    return every[0].to_numpy(), edge, place.astype(np.int32), terms, every[2].flatten().to_numpy()[first]


class _Best:
    """The k best documents so far of each query of a block: scores (0: none), ids and whether these are null."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries = queries
        self.score, self.id, self.null = (np.zeros((len(queries), k), t) for t in (float, np.int64, bool))

    def put(self, q: int, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        score, ids, null = (np.concatenate([x[q], y]) for x, y in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.score.shape[1]]
        self.score[q], self.id[q], self.null[q] = score[order], ids[order], null[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        q, r = np.nonzero(self.score > 0)
        for a in range(0, len(q), 100_000):
            x = q[a : a + 100_000], r[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.queries[x[0]]), pa.array(self.id[x], mask=self.null[x]), pa.array(self.score[x])], names=["query_id", "doc_id", "score"])


def _searcher(blocks: list, k: int, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[_Best] = []
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            shard = _load(held, mean)
            ids, null = np.array([i or 0 for i in shard.ids], np.int64), np.array([i is None for i in shard.ids])
            for x, block in enumerate(blocks):
                queries, edge, place, terms, idf = block.value
                if len(blocks) > 1:  # one block is held at a time
                    vars(block).pop("_value", None)
                if x == len(best):
                    best.append(_Best(queries, k))
                for q, docs, score in shard.answer(shard.weigh(terms, idf)[place], edge, best[x].score[:, -1].copy(), k):
                    best[x].put(q, ids[docs], null[docs], score)

        kind, docs, postings = -1, 0, 0
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edge, edge[1:]):
                some = batch.slice(a, b - a)  # of one shard
                if len(some) and some.column("part")[0].as_py() == 0:
                    # Small shards of one kind are searched as one.
                    n, p = len(some.column("ids")[0]), some.column("postings")[0].as_py()
                    if held and (shard[a] >> 48 != kind or docs + n > SHARD_DOCS or postings + p > MOST_POSTINGS):
                        finish()
                    if not held:
                        kind, docs, postings = shard[a] >> 48, 0, 0
                    docs, postings = docs + n, postings + p
                if len(some):
                    held.append(some)
        if held:
            finish()
        pa.default_memory_pool().release_unused()
        for some in best:
            yield from some.rows()

    return run
