"""Best-fit packing of documents into training sequences of several permitted lengths.

A document's tokens are its words (what lies between white space) and one end mark. It is cut into pieces of at most
the largest length. Pieces are dealt by a hash into shards of about SHARD_TOKENS tokens, and each shard is packed on
its own, largest pieces first. A piece goes into the open bin that it fills best. Where it fits in none, a bin is
opened of the length at which a token costs least, judged for all lengths jointly by filling the rest of such a bin
with the pieces that are still to come. At the end each bin shrinks to the least permitted length that holds it.

Defined cases: a null or empty text is its end mark alone. Rows with equal ids are documents of their own. Equal pieces
are packed in the order of id and piece. Input columns other than id and text are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import materialise

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length.
FIXED_COST = 64
SHARD_TOKENS = 1 << 21
#: Tasks that shards are dealt to, in turns; beyond as many shards a task packs several, one after the other.
MOST_TASKS = 20_000


def _filled(first: int, size: int, lengths: list[int], left: dict[int, int]) -> int:
    """Tokens in a bin of this size that holds `first` and then, again and again, the largest piece left that fits."""
    used, taken, hi = first, Counter({first: 1}), len(lengths)
    while hi:
        hi = bisect_right(lengths, size - used, 0, hi)
        while hi and left[lengths[hi - 1]] <= taken[lengths[hi - 1]]:
            hi -= 1
        if hi:
            n = lengths[hi - 1]
            k = min(left[n] - taken[n], (size - used) // n)
            used += n * k
            taken[n] += k
    return used


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, fixed_cost: int = FIXED_COST) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Bin and offset of each piece, and each bin's length. Pieces are 1 to max(lengths) tokens."""
    permitted = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left = Counter(sizes)
    distinct = sorted(left)
    rooms: list[int] = []
    at: dict[int, list[int]] = defaultdict(list)
    used: list[int] = []
    room: list[int] = []
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order:
        n = sizes[i]
        k = bisect_left(rooms, n)
        if k < len(rooms):
            b = at[rooms[k]].pop()
            if not at[rooms[k]]:
                rooms.pop(k)
        else:
            best = min((c for c in permitted if c >= n), key=lambda c: ((c + fixed_cost) / _filled(n, c, distinct, left), c))
            b = len(used)
            used.append(0)
            room.append(best)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room[b] -= n
        left[n] -= 1
        if not left[n]:
            distinct.remove(n)
        if room[b]:
            if not at[room[b]]:
                insort(rooms, room[b])
            at[room[b]].append(b)
    return bins, offsets, {b: permitted[bisect_left(permitted, u)] for b, u in enumerate(used)}


def pieces(documents: DataFrame, id_col: str, text_col: str, longest: int, with_text: bool) -> DataFrame:
    """(doc_id, piece, first_word, n_tokens, text): documents cut every `longest` tokens; text is null unless wanted."""
    base = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([base.schema["doc_id"], *T._parse_datatype_string("piece int, first_word long, n_tokens long, text string").fields])
    kind = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for a, b in tk.slices(offs):
                lo = int(offs[a])
                raw = data[lo : offs[b]]
                w = tk.words(raw, offs[a : b + 1] - lo, tk.NOT_SPACE)
                n = np.diff(w.first)
                count = n // longest + 1
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                begin = piece * longest
                size = np.minimum(longest, n[doc] + 1 - begin)
                texts = pa.nulls(len(doc), kind)
                if with_text:
                    texts = pa.array([_between(w, raw, int(i), int(j)) for i, j in zip(w.first[doc] + begin, np.minimum(w.first[doc] + begin + size, w.first[doc + 1]), strict=True)], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(size), texts], names=schema.names)

    return base.mapInArrow(run, schema)


def _between(w: tk.Words, raw: np.ndarray, i: int, j: int) -> str:
    """The text from word i to word j - 1 as it stands."""
    return raw[w.starts[i] : w.ends[j - 1]].tobytes().decode() if i < j else ""


def pack_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, fixed_cost: int = FIXED_COST, shard_tokens: int = SHARD_TOKENS, with_text: bool = False) -> DataFrame:
    """(doc_id, piece, first_word, n_tokens, bin_id, at, capacity), one row a piece: where it lies in which sequence. With with_text also text, the piece's own."""
    cut = pieces(documents, id_col, text_col, max(lengths), with_text)
    if not with_text:
        cut = materialise(cut, "pieces")
    # Texts aren't written a second time: a first pass over the documents counts, and they are cut again as they are dealt.
    total = (pieces(documents, id_col, text_col, max(lengths), False) if with_text else cut).agg(F.sum("n_tokens")).first()[0] or 0
    shards = -(-total // shard_tokens) or 1
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    extra = ["text"] if with_text else []
    names = ["doc_id", "piece", "first_word", "n_tokens", *extra]
    schema = T.StructType([*[cut.schema[c] for c in names], *T._parse_datatype_string("bin_id long, at long, capacity int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            bins, offsets, size = pack(t.column("n_tokens").to_pylist(), lengths, fixed_cost)
            shard = t.column("shard")[0].as_py()
            new = [pa.array(bins + (shard << 32)), pa.array(offsets), pa.array(np.array([size[b] for b in bins.tolist()], np.int32))]
            yield from pa.Table.from_arrays([*[t.column(c) for c in names], *new], names=schema.names).to_batches()

        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                if held and held[-1].column(held[-1].schema.get_field_index("shard"))[0].as_py() != shard[a]:
                    yield from finish()
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish()

    tasks = min(shards, MOST_TASKS)
    spread = dealt.select(*names, "shard").repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece")
    return spread.mapInArrow(run, schema)
