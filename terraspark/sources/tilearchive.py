"""Tile archives as a Python data source: spark.read.format("tilearchive").load(folder or file).

Rows are tiles (tileset, z, x, y, tile_id, format, data) of all *.pmtiles archives of a folder, whose names without the
ending are the tile sets; a folder without any, or none at all, gives no rows. The path is local or of any store that
pyarrow.fs opens (s3://, gs://, hdfs://), of which only the ranges that are needed are read: the driver reads headers and root
directories, tasks read leaf directories and tiles. Data come without gzip; other compressions are an error.
"""

from __future__ import annotations

import gzip
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.requests import ARCHIVE_FORMATS
from ..operators.tiles import tile_of
from . import pmtiles

SCHEMA = "tileset string, z int, x long, y long, tile_id long, format string, data binary"
HEADER = 127
#: Entries of a root directory, and bytes of their tiles, in one partition.
ENTRIES, SPAN = 4096, 64 << 20


def opened(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def archives(path: str) -> list[str]:
    """Archives at a path, as paths within its file system."""
    from pyarrow import fs

    store, root = opened(path)
    at = store.get_file_info(root)
    if at.type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(root))]
        return sorted(f for f in found if f.endswith(".pmtiles"))
    return [root] if at.type == fs.FileType.File else []


class Part(InputPartition):
    def __init__(self, name: str, header: bytes, entries: list[tuple[int, int, int, int]]):
        super().__init__((name, len(entries)))
        self.name, self.header, self.entries = name, header, entries


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        store, _ = opened(self.path)
        out = []
        for name in archives(self.path):
            with store.open_input_file(name) as f:
                header = f.read_at(HEADER, 0)
                if header[:8] != b"PMTiles\x03" or not set(header[97:99]) <= {1, 2}:
                    raise ValueError(f"{name} is no archive of version 3 with gzip or no compression")
                at, size = struct.unpack("<2Q", header[8:24])
                held, total = [], 0
                for e in pmtiles.entries(f.read_at(size, at), header[97] == 2):
                    # A leaf directory stands for many tiles: it is a partition of its own.
                    held.append(e)
                    total += e[2] if e[3] else SPAN
                    if total >= SPAN or len(held) == ENTRIES:
                        out.append(Part(name, header, held))
                        held, total = [], 0
                if held:
                    out.append(Part(name, header, held))
        return out or [Part("", b"", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.entries:
            return
        h = partition.header
        leaves, tiles = struct.unpack("<Q", h[40:48])[0], struct.unpack("<Q", h[56:64])[0]
        tileset = partition.name.rsplit("/", 1)[-1].removesuffix(".pmtiles")
        kind = ARCHIVE_FORMATS.get(h[99], "mvt")
        store, _ = opened(self.path)
        with store.open_input_file(partition.name) as f:
            queue = list(reversed(partition.entries))
            while queue:
                first, at, size, run = queue.pop()
                if not run:
                    queue += reversed(pmtiles.entries(f.read_at(size, leaves + at), h[97] == 2))
                    continue
                data = f.read_at(size, tiles + at)
                data = gzip.decompress(data) if h[98] == 2 else data
                for tile in range(first, first + run):
                    yield tileset, *tile_of(tile), tile, kind, data


class TileArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilearchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(TileArchives)
