"""Word shingles of whole texts as hashes, and how many documents hold each, in a sketch of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 5
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = _inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, from running sums.

    A substring has the same hash wherever and in whichever data it stands.
    """
    global _powers, _inverse
    if len(_powers) <= len(data):
        n = 2 * len(data) + 4096
        _powers = np.cumprod(np.r_[_U(1), np.full(n, _BASE, np.uint64)])
        _inverse = np.cumprod(np.r_[_U(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the runs of ``width`` words (lower case, without marks) and how often each occurs.

    A text of fewer words has one run of all its words; a text without words has none.
    """
    words = text.lower().encode().translate(_TO_SPACE).split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    # a word's length plus the space after it
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    return np.unique(substring_hashes(data, starts[:n], ends[-n:]), return_counts=True)


BANDS, _ROWS = 12, 2
_ODD = (np.random.default_rng(5).integers(1, 1 << 63, BANDS * _ROWS, dtype=np.uint64) << _U(1)) | _U(1)
#: A group of copies is large from this share of all rows on; rarer shingles than twice that share count as if they had it.
LARGE = 1 / 8192


def plain_bands(h: np.ndarray) -> np.ndarray:
    """Keys of bands of plain minimum hashes; copies of a document have most of them in common with it."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.array([(h * k).min() for k in _ODD]).reshape(BANDS, _ROWS)
    return mix(mix(least[:, 0] + np.arange(BANDS, dtype=np.uint64)) ^ least[:, 1]).view(np.int64)


def large_groups(nodes: DataFrame, rows: int) -> list[int]:
    """Band keys (of the column plain) of groups of copies of more than a share ``LARGE`` of all rows, of two rows at least.

    There can't be more than ``BANDS`` / ``LARGE`` of them, whatever the input, so none is left out.
    """
    sizes = nodes.select(F.explode("plain").alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    return [r["band"] for r in sizes.where(F.col("n") > max(1, rows * LARGE)).select("band").collect()]


SKETCH_BITS, SKETCH_ROWS, _CHUNK = 20, 2, 1 << 15


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return ((h >> _U(row * SKETCH_BITS)) & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)


class Frequencies:
    """Document frequencies of shingles from a sketch of 2 x 2^20 counts.

    Of each count the mean is taken off, which is what other shingles add to it. The sketch tells frequencies from a share of
    the corpus on; whatever is rarer counts as having that share, 2 * ``LARGE``, at every size of the corpus.
    """

    def __init__(self, table: np.ndarray, documents: int) -> None:
        self.documents = documents
        least = max(1.0, documents * 2 * LARGE)
        self.table = np.maximum(np.rint(table - table.mean(1, keepdims=True)), least).astype(np.float32)

    def idf(self, h: np.ndarray) -> np.ndarray:
        """Inverse document frequencies: log(1 + documents / frequency)."""
        df = np.minimum(*(self.table[row][_cells(h, row)] for row in range(SKETCH_ROWS)))
        return np.log1p(max(self.documents, 1) / df.astype(np.float64))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one needs, after a byte that says how many."""
    size = next(k for k in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * k - (k == 8)))
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def frequencies(nodes: DataFrame, large: list[int]) -> Frequencies:
    """Of the columns h (shingle hashes) and plain (band keys); rows of large groups of copies aren't counted, since what copies
    share is frequent by being copied. That sets weights alone: every row stays in all bands, buckets and comparisons. Each task sums up its own rows first."""
    schema = "chunk int, counts binary"
    sent = nodes.sparkSession.sparkContext.broadcast(np.array(sorted(large), "<i8").tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped = frozenset(np.frombuffer(sent.value, "<i8").tolist())
        table, n = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64), 0
        held, size = [], 0

        def add() -> None:
            h = np.concatenate(held)
            for row in range(SKETCH_ROWS):
                np.add.at(table[row], _cells(h, row), 1)

        for batch in batches:
            for h, plain in zip(batch.column("h"), batch.column("plain").to_pylist(), strict=True):
                if not skipped.isdisjoint(plain):
                    continue
                held.append(np.frombuffer(h.as_buffer(), "<u8"))
                n, size = n + 1, size + len(held[-1])
                if size > 1 << 20:
                    add()
                    held, size = [], 0
        if held:
            add()
        parts = [np.array([n]), *table.reshape(-1, _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts) - 1), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())], ["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of the chunks dealt to this task
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _unpacked(counts)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], ["chunk", "counts"])

    rows = nodes.select("h", "plain").mapInArrow(count, schema).repartition(16, "chunk").mapInArrow(total, schema)
    found = {r["chunk"]: _unpacked(r["counts"]) for r in rows.collect()}  # 16 MB at most, whatever the input
    if not found:
        return Frequencies(np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS)), 0)
    chunks = SKETCH_ROWS * (1 << SKETCH_BITS) // _CHUNK
    return Frequencies(np.concatenate([found[k] for k in range(chunks)]).reshape(SKETCH_ROWS, -1), int(found[-1][0]))
