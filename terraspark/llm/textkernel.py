"""Words, word hashes and window hashes of Arrow text columns, computed in numpy over raw UTF-8 bytes.

A batch is handled in slices of about SLICE bytes, so that temporaries stay bounded. A longer text is one slice; who
can work on parts of a text takes them by parts(). Null texts have no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62, dtype=np.uint64)) * 2 + 1
_MASK = (1 << 64) - 1

#: Bytes that belong to a word: all but white space; and digits, a-z, A-Z and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: A-Z to a-z, all else as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column, without a copy; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, budget: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about budget bytes."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + budget, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def parts(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, budget: int = SLICE) -> Iterator[tuple[int, int, int, int]]:
    """(first document, document after, first byte, byte after): groups of whole documents, and of a document of over budget bytes several parts of it, between whose words they are cut."""
    for a, b in slices(offs, budget):
        lo, end = int(offs[a]), int(offs[b])
        if b > a + 1 or end - lo <= budget:
            yield a, b, lo, end
            continue
        while lo < end:
            cut = min(lo + budget, end)
            while cut < end:
                gap = np.flatnonzero(~kind[data[cut : min(cut + budget, end)]])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut = min(cut + budget, end)
            yield a, b, lo, cut
            lo = cut


@dataclass
class Words:
    """Words of consecutive documents: byte range, document, and the first word of each document (n + 1)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1, one space between."""
        s, e, raw = self.starts[a:b].tolist(), self.ends[a:b].tolist(), self.data
        return b" ".join(raw[i:j].tobytes() for i, j in zip(s, e, strict=True))


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> Words:
    mask = kind[data]
    n, edge = len(data), offs[1:-1]
    begins, stops = mask.copy(), mask.copy()
    if n:
        begins[1:] &= ~mask[:-1]
        stops[:-1] &= ~mask[1:]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = mask[edge]
        stops[edge - 1] = mask[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(data, starts, ends, doc, first)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _places(a: int, b: int) -> np.ndarray:
    """Factors of the bytes at places a to b - 1 of a word."""
    if b <= len(_PLACE):
        return _PLACE[a:b]
    return np.concatenate([_PLACE[a:b], mix(np.arange(max(a, len(_PLACE)), b, dtype=np.uint64)) | np.uint64(1)])


def word_hashes(w: Words, longest: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, or of its first `longest` bytes."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(w.starts), np.uint64)
    size = np.minimum(w.ends - w.starts, longest) if longest else w.ends - w.starts
    upto = np.cumsum(size)
    step = 1 << 18
    for a, b in slices(np.concatenate([[0], upto]), step):
        k = size[a:b]
        if k[0] > step:  # a word of more bytes than a slice is summed up piece by piece
            total, lo = int(k[0]), int(w.starts[a])
            for i in range(0, int(k[0]), step):
                j = min(i + step, int(k[0]))
                total += int((_BYTE[w.data[lo + i : lo + j]] * _places(i, j)).sum(dtype=np.uint64))
            out[a] = total & _MASK
            continue
        base = np.cumsum(k) - k
        at = np.arange(int(k.sum())) - np.repeat(base, k)
        place = _places(0, int(k.max()))
        out[a:b] = np.add.reduceat(_BYTE[w.data[np.repeat(w.starts[a:b], k) + at]] * place[at], base) + k.astype(np.uint64)
    return mix(out)


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if n >= len(_powers):
        size = max(n + 1, 1 << 18)
        inv = pow(_BASE, -1, 1 << 64)
        _powers, _inverse = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, x, np.uint64))]) for x in (_BASE, inv))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (len(h) - k + 1, or none), across documents too: see windows_inside."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    _grow(len(h))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers[: len(h)])])
    return mix((total[k:] - total[:-k]) * _inverse[: len(h) - k + 1])


def windows_inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Of the windows of window_hashes, those within one document."""
    return doc[k - 1 :] == doc[: max(0, len(doc) - k + 1)]


def replace_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], keep: list[str]) -> pa.RecordBatch:
    """The batch's columns in keep, then the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + list(new.values()), names=keep + list(new))


def cover(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of n places lie in [start, start + size) of any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge[:-1]) > 0
