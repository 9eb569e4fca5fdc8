"""Map extracts in the public protobuf block format, as a Python data source: spark.read.format("osmpbf").load(files).

Rows are elements (kind, id, lat, lon, tags map, refs array, and points, an array of (lat, lon), of ways that carry
their nodes' positions). A partition is a run of whole blocks of one file. The
files must be readable as local paths by the executors (a mounted store); anything else is an error.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, points array<struct<lat:double,lon:double>>"
#: Bytes of blocks in one partition.
SPAN = 32 << 20


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or the bytes of anything else."""
    at, end = 0, len(raw)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = number()
            yield tag >> 3, raw[at : at + size]
            at += size


def numbers(raw: bytes, signed: bool = False, steps: bool = False) -> list[int]:
    """A packed list of varints, zigzag and as differences where wanted."""
    out, value, shift, last = [], 0, 0, 0
    for b in raw:
        value |= (b & 127) << shift
        if b >= 128:
            shift += 7
            continue
        v = (value >> 1) ^ -(value & 1) if signed else value
        last = last + v if steps else v
        out.append(last)
        value = shift = 0
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def elements(block: bytes) -> Iterator[tuple]:
    """The rows of one primitive block."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = _signed(v)
        elif k == 20:
            lon0 = _signed(v)
    where = lambda v, zero: (zero + grain * v) * 1e-9
    named = lambda keys, values: {strings[a]: strings[b] for a, b in zip(keys, values, strict=True)}
    for group in groups:
        for k, v in fields(group):
            if k == 2:
                part = dict(fields(v))
                ids, lats, lons = (numbers(part.get(n, b""), True, True) for n in (1, 8, 9))
                kv, at = numbers(part.get(10, b"")), 0
                for i, a, o in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, where(a, lat0), where(o, lon0), tags, None, None
            elif k in (1, 3, 4):
                part = dict(fields(v))
                tags = named(numbers(part.get(2, b"")), numbers(part.get(3, b"")))
                if k == 1:
                    i, a, o = ((part[n] >> 1) ^ -(part[n] & 1) for n in (1, 8, 9))
                    yield "node", i, where(a, lat0), where(o, lon0), tags, None, None
                else:
                    refs = numbers(part.get(8 if k == 3 else 9, b""), True, True)
                    lats, lons = (numbers(part.get(n, b""), True, True) if k == 3 else [] for n in (9, 10))
                    points = [(where(a, lat0), where(o, lon0)) for a, o in zip(lats, lons, strict=True)] or None
                    yield "way" if k == 3 else "relation", _signed(part[1]), None, None, tags, refs, points


def blobs(f) -> Iterator[tuple[int, str, int]]:
    """(start of the body, kind, size of the body) of a file's blobs."""
    while head := f.read(4):
        parts = dict(fields(f.read(struct.unpack(">I", head)[0])))
        yield f.tell(), parts[1].decode(), parts[3]
        f.seek(parts[3], os.SEEK_CUR)


def inflate(body: bytes) -> bytes:
    parts = dict(fields(body))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("blocks must be plain or zlib-compressed")


class Blocks(InputPartition):
    def __init__(self, path: str, at: list[tuple[int, int]]):
        super().__init__((path, at))
        self.path, self.at = path, at


class PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Blocks]:
        files = sorted(glob.glob(os.path.join(self.path, "*.osm.pbf"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        out = []
        for name in files:
            held, total = [], 0
            with open(name, "rb") as f:
                for at, kind, size in blobs(f):
                    if kind != "OSMData":
                        continue
                    if held and total + size > SPAN:
                        out.append(Blocks(name, held))
                        held, total = [], 0
                    held.append((at, size))
                    total += size
            if held:
                out.append(Blocks(name, held))
        return out

    def read(self, partition: Blocks) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for at, size in partition.at:
                f.seek(at)
                yield from elements(inflate(f.read(size)))


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(OsmPbf)
