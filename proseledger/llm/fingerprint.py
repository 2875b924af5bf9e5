"""Lempel-Ziv phrase fingerprints: documents that compress alike have like fingerprints.

A document's UTF-8 bytes are parsed into phrases, each the longest known phrase and one more byte (LZ78). The hashes of
the phrases form a set; a minimum hash is taken in each of 64 equal ranges of hashes, and ranges without a phrase
borrow the next one's. The likeness of two fingerprints, the share of equal minima, estimates the Jaccard similarity
of the phrase sets.

Each document is also compared with the next one in descending order of ids and with an edited text: its last half
replaced by as many first code points of the next document. Neighbours come together by one shuffle in ranges of ids; a
range's first document is also sent to the range before.

Cases: a null text counts as empty; the fingerprint of an empty text is empty, and two empty ones are alike (1), an
empty and another one not (0); null ids come last; rows with equal ids are in the order of their texts; the only row of a
table is its own next; an empty table gives an empty one; long texts are parsed whole; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of
from .shingles import mix, substring_hashes

LANES = 64
_U = np.uint64


class PhraseParser:
    """An LZ78 parser that can go on from where a copy of it stopped."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.node = self.size = 0
        self.ends: list[int] = []

    def copy(self) -> PhraseParser:
        other = PhraseParser()
        other.known, other.node, other.size, other.ends = self.known.copy(), self.node, self.size, self.ends.copy()
        return other

    def feed(self, data: bytes) -> PhraseParser:
        known, node, ends = self.known, self.node, self.ends
        get = known.get
        n = len(known)
        for at, byte in enumerate(data, self.size + 1):
            key = node << 8 | byte
            node = get(key, 0)
            if not node:
                n += 1
                known[key] = n
                ends.append(at)
        self.node, self.size = node, self.size + len(data)
        return self

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the phrases; the last one may be a known phrase."""
        ends = np.array(self.ends + [self.size] * (not self.ends or self.ends[-1] < self.size), np.int64)
        return np.r_[0, ends[:-1]], ends


def minima(data: bytes, parser: PhraseParser) -> str:
    """The fingerprint of parsed data: 64 times 16 bits in hexadecimal digits."""
    if not data:
        return ""
    starts, ends = parser.spans()
    h = np.sort(substring_hashes(np.frombuffer(data, np.uint8), starts, ends))
    lower = np.arange(LANES, dtype=np.uint64) << _U(58)
    at = np.searchsorted(h, lower)
    least = h[np.minimum(at, len(h) - 1)]
    full = (at < len(h)) & (least >> _U(58) == np.arange(LANES, dtype=np.uint64))
    owners = np.flatnonzero(full)
    lender = owners[np.searchsorted(owners, np.arange(LANES)) % len(owners)]
    distance = (lender - np.arange(LANES)) % LANES
    return (mix(least[lender] + distance.astype(np.uint64)) >> _U(48)).astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    data = text.encode()
    return minima(data, PhraseParser().feed(data))


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def edited_text(text: str, following: str) -> tuple[str, str]:
    """What stays of a text, and what takes the place of its last half."""
    half = len(text) // 2
    return text[: len(text) - half], following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint. No shuffle."""
    rows = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(parse, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _in_ranges(rows: DataFrame, range_bytes: int, most: int) -> tuple[DataFrame, int]:
    """``rows`` with the number of their range of ids, from the largest ids down; null ids are in the last range.

    Ids are cut finely by rows first; neighbouring parts are then put together until they hold ``range_bytes``.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    range_bytes = max(range_bytes, -(-size // most))
    parts = int(min(4 * most, max(32, 4 * size // range_bytes)))
    cuts = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts)).alias("c")).first()["c"]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def numbered(cuts: np.ndarray) -> DataFrame:
        @F.pandas_udf("int")
        def number(ids: pd.Series) -> pd.Series:
            at = len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64))
            return pd.Series(np.where(ids.isna(), len(cuts), at).astype("i4"))

        return rows.withColumn("bucket", number("id"))

    # as many rows as there are parts
    sizes = {r["bucket"]: r["b"] for r in numbered(cuts).groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    kept, held = [], 0
    for k in range(len(cuts)):  # the ids over cuts[-1 - k] are in the parts up to k
        held += sizes.get(k, 0)
        if held + sizes.get(k + 1, 0) > range_bytes:
            kept.append(cuts[-1 - k])
            held = 0
    cuts = np.array(kept[::-1], np.int64)
    return numbered(cuts), len(cuts) + 1


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16 << 20, most_ranges: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ranges are even in bytes and each is a partition of its own. They are streamed, so their size doesn't matter for memory;
    their number is bounded for the driver's sake, so beyond 1.6 TB they grow (to 1 GB at 100 TB).
    """
    spark = docs.sparkSession
    rows, ranges = _in_ranges(docs.select(docs[id_col].cast("long").alias("id"), text_of(text_col).alias("text")), range_bytes, most_ranges)
    # of each range the first id: as many rows as there are ranges
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect())
    before = [(tops[k][1], tops[k - 1][0]) for k in range(len(tops))]  # the first range's goes to the last
    tops_table = F.broadcast(spark.createDataFrame(before, "top long, receiver int"))
    guests = rows.join(tops_table, F.col("id").eqNullSafe(F.col("top"))).groupBy("receiver").agg(F.max("id").alias("id"), F.min("text").alias("text"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)).withColumnRenamed("receiver", "bucket"))
    ordered = both.repartitionById(ranges, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # range, id, text, fingerprint, parser after the part that stays, that part
        for batch in batches:
            out: list[tuple] = []
            for bucket, guest, doc, text in zip(*(batch.column(c) for c in ("bucket", "guest", "id", "text")), strict=True):
                bucket, guest, doc, text = bucket.as_py(), guest.as_py(), doc.as_py(), text.as_py()
                data = text.encode()
                kept = text[: len(text) - len(text) // 2].encode()
                start = PhraseParser().feed(kept)
                own = minima(data, start.copy().feed(data[len(kept) :]))
                if held and held[0] == bucket:
                    _, before_id, before_text, before_print, before_start, before_kept = held
                    new = text[: len(before_text) // 2].encode()
                    edited = before_kept + new
                    edited_print = minima(edited, before_start.feed(new))
                    out.append((before_id, len(before_text), hashlib.sha256(edited).hexdigest(), before_print, edited_print, likeness(before_print, edited_print), likeness(before_print, own)))
                held = None if guest else (bucket, doc, text, own, start, kept)
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("bucket", "guest", "id", "text").mapInArrow(compare, schema).withColumnRenamed("id", id_col)
