"""Near-dedup by word shingles: every pair at or above a similarity is found, beyond what SimHash links.

simhash.keep_one goes first. Of what it leaves, documents link whose sets of SHINGLE-word shingles (A-Z lower-cased)
have a Jaccard similarity of at least LEAST, and one of each group of linked documents stays.

Candidates are exact (prefix filter): all shingles have one order, and two sets that are similar enough share one of
the first n - LEAST * n + 1 of each. The order puts shingles that a sample of documents repeats last, so entries stay
small; what it is decides cost alone. Candidates are verified on their whole sets. Shingles are compared by 64-bit hash.

Candidates that share a shingle by chance grow with the square of the documents, so their texts are not joined: each
document has a signature, one bit for a shingle or two, and two sets differ in at least as many shingles as their
signatures differ in bits. Only pairs that may be similar by that get their texts, in passes of as many pairs as a part
of the documents, whose shuffle files go with each pass.

A dense group is not compared pair by pair (connections): first each document is verified against its neighbour in every
entry, which links a group whose members are alike with as many comparisons as it has entries. Only documents that are
not connected then are compared with each other. Entries of over CROWD documents are cut into blocks, and every two
blocks are compared by a task of their own.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words link to none here. The smallest
id of a group stays, rows without an id only where the group has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import simhash
from . import textkernel as tk
from .shared import materialise, scratch

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Documents in the sample, and the most repeated shingles taken from it.
SAMPLE, REPEATED = 16_384, 500_000
#: Keys up to which a table of them is broadcast.
FEW = 1_000_000
#: Documents of an entry that are compared in one task; entries up to SMALL are compared by vector operations over all of them.
CROWD, SMALL = 4096, 32
#: Bits of the smallest signature. Passes in which as many pairs as there are rows get their texts.
LEAST_BITS, PASSES_A_ROW = 512, 4


def shingles(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of distinct shingles, sorted by both."""
    w = tk.words(tk.FOLD[data], offs, tk.NOT_SPACE)
    h, size = tk.word_hashes(w), np.diff(w.first)
    docs, hashes = [], []
    for k in range(1, shingle + 1):
        at = np.flatnonzero(tk.windows_inside(w.doc, k))
        if k < shingle:  # whole texts of k words
            at = at[size[w.doc[at]] == k]
        if len(at):
            docs.append(w.doc[at])
            hashes.append(tk.window_hashes(h, k)[at])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, got = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((got, doc))
    doc, got = doc[order], got[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (got[1:] != got[:-1])])
    return doc[new], got[new]


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, document, shingle) by slices of a batch (key, text); documents count from the slice's first."""
    data, offs = tk.buffers(batch.column(1))
    keys = batch.column(0).to_numpy()
    for a, b in tk.slices(offs):
        yield keys[a:b], *shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle)


def _repeated(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have (sorted), and how many have them."""
    parts = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, got in _sets(batch, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64))], names=["shingle"])

    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == 0).mapInArrow(run, "shingle long")
    most = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(REPEATED).toArrow()
    got, n = most.column(0).to_numpy().view(np.uint64), most.column(1).to_numpy()
    order = np.argsort(got)
    return got[order], n[order]


def _entries(rows: DataFrame, shingle: int) -> DataFrame:
    """(shingle, key, n, pos): the prefix of each document's set in the common order, the set's size and the place in it."""
    common = rows.sparkSession.sparkContext.broadcast(_repeated(rows, shingle))
    num, den = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        for batch in batches:
            for keys, doc, got in _sets(batch, shingle):
                if not len(doc):
                    continue
                often = np.zeros(len(got), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, got), len(known) - 1)
                    often = np.where(known[at] == got, times[at], 0)
                order = np.lexsort((got, often, doc))
                doc, got = doc[order], got[order]
                n = np.bincount(doc, minlength=len(keys))
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                n = n[doc]
                take = pos <= n - -(-num * n // den)
                yield pa.RecordBatch.from_arrays([pa.array(got[take].view(np.int64)), pa.array(keys[doc[take]]), pa.array(n[take].astype(np.int32)), pa.array(pos[take].astype(np.int32))], names=["shingle", "key", "n", "pos"])

    return rows.mapInArrow(run, "shingle long, key long, n int, pos int")


def _near_enough(n: np.ndarray, left: np.ndarray, m: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar that share at most `left` and `right` of them."""
    num, den = LEAST
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((num + den) * np.minimum(left, right) >= num * (n + m))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle, those of shingles that more than one row has; prev is the key before, where the two can be similar. One row is held over."""
    rest = None

    def emit(cols: list[np.ndarray], last: bool) -> pa.RecordBatch:
        s, key, n, pos, before = cols
        same = s[1:] == s[:-1]
        more = np.concatenate([before[:1], same])
        size = n.astype(np.int64)
        near = np.concatenate([[False], same & (key[1:] != key[:-1]) & _near_enough(size[1:], (size - pos)[1:], size[:-1], (size - pos)[:-1])])
        take = more | np.concatenate([same, [False]])
        if not last:
            take[-1] = False
        prev = pa.array(np.concatenate([key[:1], key[:-1]]), mask=~near)
        rows = [pa.array(x) for x in (s, key, n, pos)]
        return pa.RecordBatch.from_arrays([*rows, prev], names=ENTRY).filter(pa.array(take))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(4)]
        before = np.zeros(len(cols[0]), bool)
        if rest is not None:
            cols, before = [np.concatenate([x, y]) for x, y in zip(rest[:4], cols, strict=True)], np.concatenate([rest[4], before])
        yield emit([*cols, before], False)
        # The last row goes out with the next batch, when it is known whether its shingle goes on; its own prev is known now.
        held = cols[0][-1:] == cols[0][-2:-1] if len(cols[0]) > 1 else before[-1:]
        rest = [*[x[-1:] for x in cols], held]
    if rest is not None:
        yield emit(rest, True)


ENTRY = ["shingle", "key", "n", "pos", "prev"]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of different roots, from rows (shingle, block, own, root, key, n, left) that come sorted by shingle and block; only an entry's rows are held over."""
    rest: list[np.ndarray] | None = None

    def made(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], names=["a", "b"])

    def emit(s, block, own, root, key, n, left) -> Iterator[pa.RecordBatch]:
        if len(s) < 2:
            return
        start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (block[1:] != block[:-1])]))
        size = np.diff(np.concatenate([start, [len(s)]]))
        group = np.repeat(np.arange(len(start)), size)
        within = block == -1  # not cut into blocks; else two rows meet if they are of different blocks, or of the only one
        few = np.flatnonzero(size[group] <= SMALL)

        def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            apart = within[i] | (own[i] != own[j]) | (block[i] == own[i] * (1 << 20) + own[i])
            return (root[i] != root[j]) & apart & _near_enough(n[i], left[i], n[j], left[j])

        lag, i = 1, few
        while len(i):
            i = i[i + lag < len(s)]
            i = i[group[i] == group[i + lag]]
            hit = i[pairs(i, i + lag)]
            if len(hit):
                yield made(key, hit, hit + lag)
            lag += 1
        for g in np.flatnonzero(size > SMALL).tolist():
            at = np.arange(start[g], start[g] + size[g])
            of, count = np.unique(root[at], return_inverse=True, return_counts=True)[1:]
            # Largest first: each row meets those of the larger groups, so the rows of the largest don't meet each other.
            rank = np.empty(len(count), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
            order = np.argsort(rank[of], kind="stable")
            at, of = at[order], rank[of][order]
            first = np.searchsorted(of, of)
            for k in range(int(np.searchsorted(of, 1)), len(at)):
                before = at[: first[k]]
                hit = before[pairs(before, np.full(len(before), at[k]))]
                if len(hit):
                    yield made(key, hit, np.full(len(hit), at[k]))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(7)]
        if rest is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
        change = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        rest = [x[last:] for x in cols]
        yield from emit(*[x[:last] for x in cols])
    if rest is not None:
        yield from emit(*rest)


def _shared_entries(rows: DataFrame, shingle: int) -> DataFrame:
    entries = _entries(rows, shingle).repartition("shingle").sortWithinPartitions("shingle", "n", "key")
    return materialise(entries.mapInArrow(_shared, "shingle long, key long, n int, pos int, prev long"), "similar-entries")


def _candidates(rooted: DataFrame) -> DataFrame:
    """Distinct (a, b) of rows (shingle, key, n, pos, root) that share a shingle and have different roots."""
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("key").alias("rows")).where("low <> high")
    blocks = F.when(F.col("rows") > CROWD, F.ceil(F.col("rows") / CROWD).cast("long"))
    kept = rooted.join(mixed.select("shingle", blocks.alias("blocks")).hint("merge"), "shingle").withColumn("own", F.coalesce(F.pmod(F.xxhash64("key"), "blocks"), F.lit(0)))
    # Block pair (i, j), i <= j, has number i * 2**20 + j.
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least("own", j) * (1 << 20) + F.greatest("own", j))
    each = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(numbers))
    dealt = kept.select("shingle", each.alias("block"), "own", "root", "key", F.col("n").cast("long").alias("n"), (F.col("n") - F.col("pos")).cast("long").alias("left"))
    dealt = dealt.repartition("shingle", "block").sortWithinPartitions("shingle", "block")
    return dealt.mapInArrow(_paired, "a long, b long").groupBy("a", "b").agg(F.lit(1)).select("a", "b")


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """(key, n, bits) of rows (key, text): the size of the set, and a bit for each of at least n places (a power of two), set where an odd number of its shingles fall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, doc, got in _sets(batch, shingle):
                n = np.bincount(doc, minlength=len(keys))
                places = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
                first = np.cumsum(places) - places
                at = first[doc] + (got & (places[doc] - 1).astype(np.uint64)).astype(np.int64)
                bits = np.packbits((np.bincount(at, minlength=int(places.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
                held = [bits[i : i + k] for i, k in zip((first // 8).tolist(), (places // 8).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32)), pa.array(held, pa.binary())], names=["key", "n", "bits"])

    return rows.mapInArrow(run, "key long, n int, bits binary")


def _may_be_similar(n: np.ndarray, left: pa.Array, m: np.ndarray, right: pa.Array) -> np.ndarray:
    """By sizes and signatures; false only where the sets can't be similar enough."""
    num, den = LEAST
    n, m = n.astype(np.int64), m.astype(np.int64)
    sides = [tk.buffers(x) for x in (left, right)]
    long = [np.diff(offs) for _, offs in sides]
    apart = np.zeros(len(n), np.int64)
    for one, two in set(zip(long[0].tolist(), long[1].tolist(), strict=True)):
        for at in np.array_split(i := np.flatnonzero((long[0] == one) & (long[1] == two)), -(-len(i) * max(one, two) // (1 << 24))):
            bits = []
            for (data, offs), size in zip(sides, (one, two), strict=True):
                rows = data[offs[at][:, None] + np.arange(size)]
                while size > min(one, two):  # to the signature that fewer places would have given
                    size //= 2
                    rows = rows[:, :size] ^ rows[:, size:]
                bits.append(rows)
            apart[at] = np.bitwise_count(bits[0] ^ bits[1]).sum(1)
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((num + den) * apart <= (den - num) * (n + m))


def _possible(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) that may be similar by their signatures: all that are, and few others."""
    keys = materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "similar-keys")
    held = materialise(_signatures(rows.join(_side(keys), "key", "left_semi").dropDuplicates(["key"]), shingle), "similar-signatures")
    both = pairs
    for side in ("a", "b"):
        both = both.join(held.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")).hint("merge"), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, left, m, right = batch.columns
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(_may_be_similar(n.to_numpy(), left, m.to_numpy(), right)))

    return both.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by their whole texts in rows (key, text)."""
    with scratch(rows.sparkSession):
        pairs = materialise(_possible(materialise(pairs, "similar-candidates"), rows, shingle), "similar-possible", keep=True)
    passes = max(1, -(-pairs.count() * PASSES_A_ROW // max(1, rows.count())))
    found = None
    for k in range(passes):
        with scratch(rows.sparkSession):
            part = pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == k)
            got = materialise(_compared(part, rows, shingle), "similar-verified", keep=True)
        found = got if found is None else found.unionByName(got)
    return found


def _compared(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    keys = materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "similar-keys")
    texts = materialise(rows.join(_side(keys), "key", "left_semi").dropDuplicates(["key"]), "similar-texts")
    # Merge joins at every size, so that what a small table costs tells what a large one will.
    both = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "one"}).hint("merge"), "a").join(texts.withColumnsRenamed({"key": "b", "text": "two"}).hint("merge"), "b").select("a", "b", "one", "two")
    num, den = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in (2, 3):
                data, offs = tk.buffers(batch.column(c))
                sets.append([got for a, b in zip(offs[:-1], offs[1:], strict=True) for _, got in [shingles(data[a:b], np.array([0, b - a]), shingle)]])
            near = [(num + den) * len(np.intersect1d(x, y, assume_unique=True)) >= num * (len(x) + len(y)) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def links(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b), a < b: the keys of all pairs of rows (key long, text) that are similar enough. Their number is what it is: in a group of copies, its square."""
    shared = _shared_entries(rows, shingle)
    return _verified(_candidates(shared.withColumn("root", F.col("key"))), rows, shingle)


def connections(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b), a < b: similar pairs of rows (key long, text), enough to connect all that links() connects."""
    shared = _shared_entries(rows, shingle)
    chain = shared.where("prev IS NOT NULL").select(F.least("key", "prev").alias("a"), F.greatest("key", "prev").alias("b")).distinct()
    first = materialise(_verified(chain, rows, shingle), "similar-chain")
    roots = materialise(components(first), "similar-roots")
    rooted = shared.join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return first.unionByName(_verified(_candidates(rooted), rows, shingle))


def _side(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= FEW else keys.hint("merge")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """simhash.keep_one, and of the rest one document of each group of similar ones. Columns as they were."""
    spark = documents.sparkSession
    with scratch(spark):
        docs = materialise(simhash.keep_one(documents, id_col, text_col), "similar-documents", keep=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col), text)
    with scratch(spark):
        found = components(materialise(connections(docs.select(key.alias("key"), text.alias("text")), shingle), "similar-links"))
        named = docs.select(key.alias("node"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key")).alias("row"))
        nodes = materialise(found, "similar-groups")
        members = materialise(named.join(_side(nodes), "node"), "similar-members")
        first = members.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.key").alias("node"))
        gone = materialise(members.join(first, "node", "left_anti").select(F.col("node").alias("__key")).distinct(), "similar-gone", keep=True)
    return docs.withColumn("__key", key).join(_side(gone), "__key", "left_anti").select(documents.columns)
