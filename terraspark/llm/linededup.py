"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least `min_chars` code points
count. Documents are taken in batches from the largest ids to the smallest. A run is a table of keys in buckets by their
hash, each bucket sorted, so that joins with it need neither a shuffle nor a sort of it. Each batch's keys are
merge-joined with the runs of all levels and become a run themselves, with their number of documents. Keys that no run
holds (the anti-join) are owned by the largest id of the batch that holds them; rows of other keys have no owner.
Whenever a level has `fanout` runs they are merged bucket by bucket into one of the next level, so that a key has one
owner in all runs: whoever the anti-join let in. Keys found in `min_docs` documents lose their lines everywhere but in
their owner.

A key is known by 128 bits of two independent hashes. Hot keys are counted map-side before each shuffle, and joins are
sort-merge joins whose large partitions Spark splits.

Ids are integers, or are read as such. Defined cases: a null or empty text is one empty line. Rows with equal ids are one document, and each row's lines are
judged. A row without an id is in no count and keeps its lines. Other columns stay; n_lines, n_dropped and text are
set by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, materialise, new_path, remove, with_columns

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2
#: Lines in a bucket of the runs, about, and the most buckets that there are.
BUCKET_LINES, MOST_BUCKETS = 250_000, 10_000
#: A table of this many rows of two hashes and an id (32 bytes each) is broadcast; a larger one is merge-joined.
SMALL_ROWS = 200_000
KEY = ["h1", "h2"]


def line_key(line):
    """Upper case goes by translate only where there is more than ASCII; lower() is the same there and faster."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, top) in the shared folder; top is null in rows of a key that an older run owns."""

    def __init__(self, spark: SparkSession, buckets: int = 1, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        """A run of rows that lie in its buckets already. Hashes don't compress, and codecs' buffers are memory that no heap bounds."""
        path = new_path(self.spark, "line-run")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.format("parquet").option("compression", "uncompressed").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _merged(self, names: list[str]) -> str:
        """The runs as one, by merge joins of bucket with bucket: numbers add up, and a key has the owner that one of them has."""
        one = names[0]
        for other in names[1:]:
            old = self.spark.table(other).select(*KEY, F.col("n").alias("more"), F.col("top").alias("owner"))
            rows = self.spark.table(one).join(old.hint("merge"), KEY, "full")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            both = self._write(rows.select(*KEY, n.cast("long").alias("n"), F.coalesce("top", "owner").alias("top")))
            self._remove(one)
            self._remove(other)
            one = both
        return one

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n, top), one row a key, whose ids are all smaller than those before."""
        with _sorted_scans(self.spark):
            held = F.lit(False)
            rows = batch.repartition(self.buckets, *KEY)
            for i, r in enumerate(self.runs()):
                owned = self.spark.table(r).where(F.col("top").isNotNull()).select(*KEY, F.lit(True).alias(f"in{i}"))
                rows = rows.join(owned.hint("merge"), KEY, "left")
                held |= F.col(f"in{i}").isNotNull()
            run = self._write(rows.select(*KEY, "n", F.when(~held, F.col("top")).alias("top")))
        self._push(run, 0)

    def _push(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            with _sorted_scans(self.spark):
                merged = self._merged(old)
            self._push(merged, level + 1)

    def common(self, min_docs: int) -> DataFrame:
        """Keys in at least min_docs documents and the owner of each, as a table."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, top long")
        with _sorted_scans(self.spark):
            self.levels = [[self._merged(self.runs())]]
        return materialise(self.spark.table(self.runs()[0]).where(F.col("n") >= min_docs).select(*KEY, "top"), "line-common")

    def close(self) -> None:
        for name in list(self.paths):
            self._remove(name)


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While this lasts, a scan of a bucket with one file says that it is sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """documents with text (without dropped lines), n_lines (before) and n_dropped."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    row = F.xxhash64("text").alias("row")
    lines = docs.select("id", row, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("id").isNotNull()).select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    edges = _edges(docs, batches)
    number = sum((F.col("id") < e).cast("int") for e in edges) if edges else F.lit(0)
    path = new_path(spark, "line-keys")
    rows = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "row", "pos", number.alias("batch"))
    rows.write.option("compression", "uncompressed").partitionBy("batch").parquet(path)
    keys = spark.read.schema("h1 long, h2 long, id long, row long, pos int, batch int").parquet(path)
    runs = LineRuns(spark, min(MOST_BUCKETS, keys.count() // BUCKET_LINES + 1), fanout)
    for b in range(len(edges) + 1):
        mine = keys.where(F.col("batch") == b).groupBy(*KEY, "id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("one").alias("n"), F.max("id").alias("top"))
        runs.add(mine)
    common = runs.common(min_docs)
    runs.close()
    side = F.broadcast(common) if common.count() <= SMALL_ROWS else common.hint("merge")
    dropped = materialise(keys.join(side, KEY).where(F.col("id") < F.col("top")).groupBy("id", "row").agg(F.collect_set("pos").alias("gone")), "line-dropped")
    remove(spark, path)
    taken = documents.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__row"), F.struct("*").alias("__all"))
    # One plan at every size, so that what a small table costs tells what a large one will.
    joined = taken.join(dropped.withColumnsRenamed({"id": "__id", "row": "__row"}).hint("merge"), ["__id", "__row"], "left")
    text = F.coalesce(F.col("__all").getField(text_col), F.lit(""))
    split = joined.select("__all", "gone", F.split(text, "\n").alias("__lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("gone"))
    cut = split.select("__all", "__lines", F.when(F.col("gone").isNotNull(), stay).alias("__stay"))
    kept = F.when(F.col("__stay").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n"))
    n = F.size("__lines").cast("long")
    done = cut.select("__all", kept.alias("__text"), n.alias("__n"), F.when(F.col("__stay").isNull(), 0).otherwise(n - F.size("__stay")).cast("long").alias("__gone"))
    flat = done.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__all.`{c}`").alias(c) for c in documents.columns], "__n", "__gone")
    out = with_columns(flat, n_lines=F.col("__n"), n_dropped=F.col("__gone"))
    return out.drop("__n", "__gone")


def _edges(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into about equal batches, largest first; which ones is a matter of balance only."""
    if batches < 2:
        return []
    low, high = docs.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    cuts = docs.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted({int(c) for c in cuts if low < c <= high}, reverse=True)
