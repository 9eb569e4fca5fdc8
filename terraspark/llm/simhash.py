"""SimHash near-dedup with multi-index hashing.

Fingerprints take the shingles of `shingle` words of the A-Z lower-cased text, repeats included. A bit is 1 if it is
set in over half of the shingles' XXH64 hashes. Two fingerprints link when at most RADIUS bits differ.

Candidates: the 64 bits are parted into segments, each with a radius, so that of two fingerprints that differ in at
most 4 bits some segment differs in no more bits than its radius. Up to FEW distinct fingerprints the segments have 21,
21 and 22 bits with radii 1, 1 and 0; beyond, 32 and 32 bits with radii 2 and 1: more visits, but entries that hold
next to nothing by chance. Each distinct fingerprint is a resident of one table entry for each segment, and a visitor of
those entries that the ball of that radius reaches (only greater ones: the other side of the pair does the rest). What
meets in an entry is verified over all 64 bits. Inside an entry a breadth-first search links what is connected there, so a dense group costs
as many links as it has members, and no pair is lost: whoever isn't linked directly is linked through others in the
entry. Entries with more than CROWD members are cut into blocks, and every two blocks are compared by a task of their own.

Defined cases: null, empty and all-blank texts have fingerprint zero and are linked like any other; a text of fewer
words than a shingle is one shingle. Rows with equal ids are rows each; a row without an id gets its group's smallest
id, or none where no row of the group has one. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .shared import materialise, plus, with_columns
from .textkernel import buffers

SHINGLE, RADIUS, SEED = 4, 4, 42
#: (lowest bit, bits, radius) of each segment, for up to FEW distinct fingerprints and for more.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
LONG_SEGMENTS = ((0, 32, 2), (32, 32, 1))
#: Here an entry of 21 bits has some thousand members by chance, and comparing them costs what the longer segments' visits do.
FEW = 1 << 28
CROWD = 4096
#: A table of this many rows (an id and a hash) is broadcast; a larger one is merge-joined.
FEW_OTHERS = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, 0 without words."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) + 1 <= shingle:
        return xxhash.xxh64_intdigest(norm, SEED)
    starts = [0, *(gaps[: len(gaps) + 1 - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(norm)]
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for a in range(0, count, 4096):
        h = np.array([digest(norm[i:j], SEED) for i, j in zip(starts[a : a + 4096], ends[a : a + 4096], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out: str = "__fp") -> DataFrame:
    """documents without the text column and with its fingerprint as a (signed) long."""
    keep = [c for c in documents.columns if c != text_col]
    base = documents.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(len(keep)))
            fps = np.fromiter((fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64, len(offs) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps.view(np.int64))], names=[*keep, out])

    return base.mapInArrow(run, plus(base.drop("__text"), **{out: "long"}))


def _ball(value, bits: int, radius: int):
    """The values that are greater and differ in 1 to radius of the low bits."""
    masks = [sum(1 << i for i in places) for n in range(1, radius + 1) for places in combinations(range(bits), n)]
    return F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m)), lambda v: v > value)


def _entries(fps: DataFrame, segments: tuple) -> DataFrame:
    """(entry, fp) of residents and visitors."""
    at = []
    for k, (low, bits, radius) in enumerate(segments):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        found = F.concat(F.array(value), _ball(value, bits, radius)) if radius else F.array(value)
        at.append(_of_segment(found, k))
    return fps.select("fp", F.explode(F.concat(*at)).alias("entry"))


def _of_segment(values, k: int):
    return F.transform(values, lambda v: v + F.lit(k << 32))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each entry of rows (entry, block, fp) that come sorted; only an entry's rows are held over."""
    rest: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def emit(part: tuple) -> Iterator[pa.RecordBatch]:
        for a, b in _linked(*part):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        e, k, f = (batch.column(i).to_numpy() for i in range(3))
        e, k, f = (np.concatenate([x, y]) for x, y in zip(rest, (e, k, f.view(np.uint64)), strict=True))
        if not len(e):
            continue
        last = int(np.flatnonzero((e != e[-1]) | (k != k[-1]))[-1]) + 1 if ((e != e[-1]) | (k != k[-1])).any() else 0
        rest = (e[last:], k[last:], f[last:])
        yield from emit((e[:last], k[:last], f[:last]))
    yield from emit(rest)


def _linked(e: np.ndarray, k: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(e) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (k[1:] != k[:-1])]))
    sizes = np.diff(np.concatenate([starts, [len(e)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    few = sizes <= 8
    for lag in range(1, 8):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & few[group[lag:]])
        i = i[np.bitwise_count(f[i] ^ f[i + lag]) <= RADIUS]
        if len(i):
            yield f[i], f[i + lag]
    for s, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
        a, b = breadth_first(f[s : s + n])
        if len(a):
            yield a, b


def breadth_first(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among f: each member is compared with those that nobody has reached yet."""
    a, b, left, queue = [], [], f, np.zeros(0, np.uint64)
    while len(left) or len(queue):
        if not len(queue):
            queue, left = left[:1], left[1:]
        at, queue = queue[0], queue[1:]
        if not len(left):
            break
        near = np.bitwise_count(left ^ at) <= RADIUS
        if near.any():
            new = left[near]
            a.append(np.full(len(new), at))
            b.append(new)
            queue, left = np.concatenate([queue, new]), left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def links(fps: DataFrame, crowd: int = CROWD, few: int = FEW) -> DataFrame:
    """(a, b) of linked fingerprints among the distinct ones in fps (fp long): enough to connect all that are connected."""
    entries = _entries(fps, SEGMENTS if fps.count() <= few else LONG_SEGMENTS)
    crowds = materialise(entries.groupBy("entry").agg(F.count("fp").alias("n")).where(F.col("n") > crowd).select("entry", F.ceil(F.col("n") / crowd).cast("long").alias("blocks")), "simhash-crowds")
    many = crowds.count()
    side = F.broadcast(crowds) if many <= 100_000 else crowds.hint("merge")
    dealt = (entries.join(side, "entry", "left") if many else entries.withColumn("blocks", F.lit(None).cast("long"))).withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks"))
    # Block pair (i, j), i <= j, has number i * blocks + j.
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(F.col("mine"), j) * F.col("blocks") + F.greatest(F.col("mine"), j))
    dealt = dealt.select("entry", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("block"), "fp")
    return dealt.repartition("entry", "block").sortWithinPartitions("entry", "block").mapInArrow(_search, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """documents with fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    rows = materialise(fingerprints(documents, text_col, shingle), "fingerprints")
    groups = _groups(rows.select(F.col(id_col).alias("id"), F.col("__fp").alias("fp")))
    out = rows.join(groups.withColumnRenamed("fp", "__fp").hint("merge"), "__fp")
    return with_columns(out, fingerprint=F.lower(F.lpad(F.hex("__fp"), 16, "0")), component_id=F.col("__component")).drop("__fp", "__component", "__first")


def _groups(rows: DataFrame) -> DataFrame:
    """(fp, __component) of each distinct fingerprint in rows (id, fp)."""
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    found = materialise(links(classes.select("fp")), "simhash-links")
    roots = components(found)
    joined = classes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = materialise(joined.groupBy("root").agg(F.min("least").alias("__component"), F.min("fp").alias("__first")), "simhash-groups")
    return joined.join(low.hint("merge"), "root").select("fp", "__component", "__first")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each group stays: that of the smallest id; of equal ids, or where there is none, one of the rows. Columns as they were."""
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = materialise(fingerprints(documents.select(row.alias("row"), F.col(text_col)), text_col, shingle), "fingerprints")
    groups = _groups(rows.select(F.col("row.id").alias("id"), F.col("__fp").alias("fp")))
    first = rows.groupBy("__fp").agg(F.min("row").alias("row")).join(groups.withColumnRenamed("fp", "__fp").hint("merge"), "__fp").groupBy("__first").agg(F.min("row").alias("__row"))
    # Few rows go, against those that stay: joining with them needs no shuffle of the texts while they are few enough to broadcast.
    times = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("row", "__row")
    marked = times.join(first.select("__row", F.lit(True).alias("one")).hint("merge"), "__row", "left").where("one IS NULL OR n > 1")
    others = materialise(marked.select("__row", F.col("one").isNotNull().alias("__repeated")), "simhash-others")
    mine = documents.select(row.alias("__row"), F.struct("*").alias("__all"))
    side = lambda df: F.broadcast(df) if df.count() <= FEW_OTHERS else df.hint("merge")
    single = mine.join(side(others), "__row", "left_anti").select("__all.*")
    # Repeated rows have equal ids and texts: one of them stays.
    repeated = mine.join(side(others.where("__repeated").select("__row")), "__row", "left_semi").groupBy("__row").agg(F.any_value("__all").alias("__all")).select("__all.*")
    return single.union(repeated)
