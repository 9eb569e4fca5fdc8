"""Connected components of a link table by alternating large-star and small-star steps, each a shuffle by node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path, remove, shuffled_by, swept

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), in either direction, repeats allowed; gives (node, root): every linked node and the smallest node it reaches.

    Each round's links are written to the shared folder and the round before is deleted. Minima are taken map-side
    before each shuffle, so a node with very many links is no burden for one task; a join with its links is a merge
    join whose large partitions Spark splits. Without links there are no rows. Shuffles have partitions by the number of
    links, up to the session's.
    """
    spark = links.sparkSession
    schema = "a long, b long"
    first = new_path(spark, "links")
    with swept(spark):
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a", "b").agg(F.lit(1)).select("a", "b").write.parquet(first)
    size = spark.read.schema(schema).parquet(first).count()
    with shuffled_by(spark, size), swept(spark):
        return _settled(spark, first, schema)


def _settled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stars that the links at path, which is deleted, come to."""

    def write(df: DataFrame) -> str:
        path = new_path(spark, "links")
        df.select("a", "b").write.parquet(path)
        return path

    def read(path: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    minima: list[str] = []

    def least(df: DataFrame, schema: str) -> DataFrame:
        """Minima as a table of their own: the join with them can then split a node's many links."""
        minima.append(new_path(spark, "minima"))
        df.write.parquet(minima[-1])
        return spark.read.schema(schema).parquet(minima[-1])

    def both(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")

    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        two = both(read(path))
        low = least(two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u long, m long")
        large = two.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").groupBy("a", "b").agg(F.lit(1))
        mid = write(large)
        # Small star: the smaller neighbours of u, and u, are linked to the smallest of them.
        down = read(mid)
        low = least(down.groupBy("a").agg(F.min("b").alias("m")), "a long, m long")
        near = down.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = near.unionByName(low.select("a", F.col("m").alias("b"))).groupBy("a", "b").agg(F.lit(1))
        after = write(small)
        for old in (path, mid, *minima):
            remove(spark, old)
        minima.clear()
        path = after
        state = read(path).agg(F.count("a"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = read(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root")))
