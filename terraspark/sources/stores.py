"""Stores of trips, contributions, places, speeds and tiles as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lat:double,lon:double,timestamp:string,speed_kmh:double,bearing:double>"
TRIPS = f"trip_id string, profile string, started_at string, ended_at string, waypoints array<{POINT}>"
PLACE = "struct<lat:double,lon:double>"
CONTRIBUTIONS = f"id string, origin {PLACE}, destination {PLACE}, profile string, issue_type string, description string, suggested_waypoints array<{PLACE}>, created_at string"
SPEEDS = "src long, dst long, sample_count long, avg_kmh double, median_kmh double, p85_kmh double, last_updated string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a file, in .json files."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """The last record saved of each trip."""
    return _latest(_json(spark, path, TRIPS), "trip_id", F.coalesce("ended_at", "started_at"))


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    return _latest(_json(spark, path, CONTRIBUTIONS), "id", F.col("created_at"))


def _latest(rows: DataFrame, key: str, when) -> DataFrame:
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, when).alias("r")).select("r.*")


def save_json(rows: DataFrame, path: str) -> None:
    """Append records."""
    rows.write.mode("append").json(path)


def waypoints(trips: DataFrame) -> DataFrame:
    """(trip_id, seq, lat, lon, t_sec) of trips, in the order of arrival."""
    from ..functions.text import rfc3339_seconds

    rows = trips.select("trip_id", F.posexplode("waypoints").alias("seq", "w"))
    return rows.select("trip_id", "seq", "w.lat", "w.lon", rfc3339_seconds(F.col("w.timestamp")).alias("t_sec"))


def save_table(rows: DataFrame, path: str, force: bool = False) -> bool:
    """Write a table; one that is there stays unless forced. Whether it was written."""
    try:
        rows.write.mode("overwrite" if force else "error").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        return False
    return True


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or no rows where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def save_tiles(tiles: DataFrame, path: str, name: str) -> None:
    """Tiles by tile set and zoom, in the order of the curve within files, so that a lookup reads few row groups."""
    tiles.withColumn("tileset", F.lit(name)).repartitionByRange("z", "tile_id").sortWithinPartitions("tile_id").write.mode("append").partitionBy("tileset", "z").parquet(path)


def read_open_places(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all Parquet files directly in a folder; none where there is no file or no folder."""
    from ..operators.ingest import open_places

    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "*.parquet")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files):
        return open_places(spark.createDataFrame([], "id string, lat double, lon double, category string, names struct<primary:string>"))
    return open_places(spark.read.option("recursiveFileLookup", False).option("pathGlobFilter", "*.parquet").parquet(path))
