"""Alignment of two tokenizers' tokens by the bytes that they stand for.

Both encode a space and the text. The ends of all tokens of both cut the bytes into elementary intervals, each of which lies in one
token of either side: one overlap. Ends that both share close a group. A link is a pair of tokens that end together; an
id pair's count is the number of its links in all documents. From those counts each document gets how many of its links are
the commonest of their second id, and the sum of its links' counts.

Documents are encoded once, in chunks of some millions of characters; a chunk keeps its links as places in its list of distinct id pairs. The lists are
summed to counts by a shuffle of one row for each pair and chunk, and joined back to the chunks' lists, so no pair's count is ever broadcast.
A chunk is many rows of bounded size: parts of its list, and runs of texts with their links, compressed. So no row of the files, of the shuffle or between the JVM
and Python is large; rows of whole chunks filled the heap and much beside it. The counts of a chunk's pairs come as rows before its links, by a sort that may spill.

Cases: a null or empty text, and a text that the tokens of either side don't give back byte for byte (such as one with U+2581, which the second
side's tokens use for a space), has no tokens: zeros and an empty digest; special tokens' strings are text; very long texts are a chunk of their own;
repeated rows are counted as often as they are there; an empty table gives an empty one; further columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library_encoder import LibraryEncoder
from .pieces import PieceTable
from .shared import batches_of, held, let_go, staged, text_of

#: What stands for the ids of a piece that its tokens don't give back.
_LOST = 0xFFFFFFFF
#: Characters of the texts that are aligned at once, and of those that share a list of id pairs.
PART, CHUNK = 1 << 19, 2 << 20
#: Most links, texts and distinct pairs in a row of a chunk; a text with more links goes over several rows.
LINKS, TEXTS, PAIRS = 1 << 17, 1 << 10, 1 << 14
#: Ids are below this; a pair of ids is one number.
_IDS = 1 << 32
_SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _tangled(text: str) -> bool:
    """Only runs of spaces have tokens across the places where texts are cut."""
    return "  " in text


class PieceEncoder:
    """Ids of a sentencepiece model for a space and a text, and the bytes of each of its ids.

    The model writes a space as U+2581 and puts one before the text. Where no vocabulary string has that mark after another
    character, merges never reach over a space, and texts are cut before spaces and line feeds.
    """

    def __init__(self, path: str, limit_bytes: int = 96 << 20) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        strings = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.token_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(s)) else s.replace(_SPACE, " ").encode() for s in strings]
        self.n_bytes = np.array([*map(len, self.token_bytes)], np.int64)
        self._space = self._model.piece_to_id(_SPACE)
        cuttable = not any(_SPACE in s.lstrip(_SPACE) or "\n" in s for s in strings)
        self.table = PieceTable(self._batch, (), limit_bytes, _tangled if cuttable else lambda _: True)

    def _batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each of texts: such as begin with a space are encoded without it, which the model adds; of others the added one is taken off."""
        found = self._model.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        out = []
        for text, ids in zip(texts, found, strict=True):
            if text == " ":
                ids = [self._space]
            elif text and text[:1] != " ":
                if ids[:1] != [self._space]:
                    raise ValueError("the model joins a space with a line feed")
                ids = ids[1:]
            sound = b"".join(map(self.token_bytes.__getitem__, ids)) == text.encode()
            out.append(array("I", ids if sound else [_LOST]).tobytes())
        return out


@dataclass
class Aligned:
    """Tokens, groups, links and overlaps of one text or of several that stand one after the other."""

    groups: np.ndarray  # the shared ends, in bytes
    last_a: np.ndarray  # number of the token of either side that ends there
    last_b: np.ndarray
    overlap_a: np.ndarray  # for each elementary interval, the token of either side that it lies in
    overlap_b: np.ndarray


def _union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy's union1d of two ascending arrays; a stable sort only merges them, which takes a fraction of the time of the library's hash table."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Of the ascending ends of two token sequences over the same bytes."""
    cuts = _union1d(ends_a, ends_b)
    overlap_a, overlap_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    if len(cuts):
        shared = (ends_a[overlap_a] == cuts) & (ends_b[overlap_b] == cuts)
        return Aligned(cuts[shared], overlap_a[shared], overlap_b[shared], overlap_a, overlap_b)
    return Aligned(cuts, overlap_a, overlap_b, overlap_a, overlap_b)


def group_products(x: Aligned) -> np.ndarray:
    """How many pairs of tokens each group holds."""
    return np.diff(x.last_a, prepend=-1) * np.diff(x.last_b, prepend=-1)


class TokenAligner:
    """Two tokenizers; aligns many texts at once."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self._a, self._b = LibraryEncoder(path_a, plain_specials=True, limit_bytes=24 << 20), PieceEncoder(path_b, limit_bytes=24 << 20)
        self._size_a, self._size_b = len(self._a.n_bytes), len(self._b.n_bytes)
        kinds = [(self._size_a, ","), (self._size_a, "|"), (self._size_b, ","), (self._size_b, ";")]
        self._written = pa.array([f"{i}{mark}".encode() for size, mark in kinds for i in range(size)], pa.binary())

    def chunk(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Of every text n_a, n_b, n_groups, n_overlaps, n_products and groups_sha256; of all the links the pair of ids, in the order of the texts."""
        spaced = [" " + t if t else "" for t in texts]
        a, b = ([np.frombuffer(x, "<u4") for x in side.table.encode_many(spaced)] for side in (self._a, self._b))
        lengths = [len(t.encode()) for t in spaced]
        for k, size in enumerate(lengths):
            # byte-level ids give back every text; of the other side each piece was compared when it was encoded
            if size and (b[k].size and b[k].max() == _LOST or self._a.n_bytes[a[k]].sum() != size or self._b.n_bytes[b[k]].sum() != size):
                a[k] = b[k] = np.zeros(0, "<u4")
        n_a, n_b = (np.array([*map(len, side)], np.int64) for side in (a, b))
        ids_a, ids_b = (np.concatenate([*side, np.zeros(0, "<u4")]).astype(np.int64) for side in (a, b))
        # texts end where tokens of both sides end, so those that follow each other are aligned as one
        ends_a, ends_b = np.cumsum(self._a.n_bytes[ids_a]), np.cumsum(self._b.n_bytes[ids_b])
        x = align(ends_a, ends_b)
        stops = np.searchsorted(x.last_a, np.cumsum(n_a))  # groups of the texts before and of this one
        starts = np.r_[0, stops[:-1]] if len(stops) else stops
        overlaps = np.diff(np.searchsorted(x.overlap_a, np.cumsum(n_a)), prepend=0)
        products = np.r_[0, np.cumsum(group_products(x))]
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": stops - starts, "n_overlaps": overlaps, "n_products": products[stops] - products[starts],
            "groups_sha256": self._digests(ids_a, ids_b, x, n_a + n_b), "pairs": ids_a[x.last_a] * _IDS + ids_b[x.last_b],
        }

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, x: Aligned, n_tokens: np.ndarray) -> list[str]:
        """Every token is written with the mark behind it, the tokens of a group's first side before those of its second."""
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[x.last_a], last_b[x.last_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups that have ended before
        before = np.r_[0, x.last_b + 1]
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + before[group_a]] = ids_a + self._size_a * last_a
        order[np.arange(len(ids_b)) + (x.last_a + 1)[group_b]] = 2 * self._size_a + ids_b + self._size_b * last_b
        written = self._written.take(pa.array(order))
        data, ends = memoryview(written.buffers()[2] or b""), np.frombuffer(written.buffers()[1], np.int32)
        stops = ends[np.cumsum(n_tokens)].tolist()
        # the last mark goes
        return [hashlib.sha256(data[low : high - 1]).hexdigest() if high > low else "" for low, high in zip([0, *stops], stops, strict=False)]


def token_aligner(path_a: str, path_b: str) -> TokenAligner:
    return held(("alignment", path_a, path_b), lambda: TokenAligner(path_a, path_b))


_COUNTS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_products")


def _runs(stops: np.ndarray, most_links: int, most_texts: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with no more links together, or of one text; ``stops`` are the numbers of links up to each."""
    first = 0
    while first < len(stops):
        before = stops[first - 1] if first else 0
        last = min(max(int(np.searchsorted(stops, before + most_links, "right")), first + 1), first + most_texts)
        yield first, last
        first = last


def _in_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths and types as compressed bytes: a column that Spark hands to Python row by row costs less the fewer parts it has."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([_in_list(c) for c in columns.values()], [*columns])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(use_threads=False)) as found:
        batch = found.read_next_batch()
    return {name: batch.column(name)[0].values for name in batch.schema.names}


def _chunk_rows(number: int, ids: pa.Array, parts: list[dict], most_links: int, most_texts: int, most_pairs: int) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk of texts: its distinct pairs, the most frequent ones first, and then its texts with the places of their links' pairs.

    A text with too many links for a row has rows before its own that hold links and no text.
    """
    pairs, links, n = np.unique(np.concatenate([x["pairs"] for x in parts]), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # small places for most links, which compress better
    place = np.empty(len(pairs), np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
    place[order] = np.arange(len(pairs))
    links = place[links]
    columns = {"ids": ids} | {c: pa.array(np.concatenate([x[c] for x in parts]), pa.int64()) for c in _COUNTS}
    columns["groups_sha256"] = pa.array([d for x in parts for d in x["groups_sha256"]], pa.string())

    def row(at: int, pairs: pa.Array, n_pairs: pa.Array, body: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([at]), pairs, n_pairs, pa.array([body], pa.binary())], ["chunk", "at", "pairs", "n_pairs", "body"])

    for low in range(0, len(pairs), most_pairs):
        some = order[low : low + most_pairs]
        yield row(low, _in_list(pa.array(pairs[some])), _in_list(pa.array(n[some], pa.int64())), None)
    at, none = len(pairs), pa.nulls(1, pa.list_(pa.int64()))
    stops = np.cumsum(columns["n_groups"].to_numpy())  # a link for each group
    for first, last in _runs(stops, most_links, most_texts):
        low, high = int(stops[first - 1]) if first else 0, int(stops[last - 1])
        while high - low > most_links:
            yield row(at, none, none, _packed({c: x.slice(0, 0) for c, x in columns.items()} | {"links": pa.array(links[low : low + most_links])}))
            low, at = low + most_links, at + 1
        yield row(at, none, none, _packed({c: x.slice(first, last - first) for c, x in columns.items()} | {"links": pa.array(links[low:high])}))
        at += 1


def _chunks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """The rows of all chunks of documents; ``at`` orders those of a chunk, and is the place of the first pair in rows of pairs."""
    rows = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = token_aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        parts: list[dict] = []
        total = 0
        for batch in batches:
            texts, first, size = batch.column("text").to_pylist(), 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= PART or k == len(texts) - 1:
                    parts.append(aligner.chunk(texts[first : k + 1]))
                    ids.append(batch.column("id").slice(first, k + 1 - first))
                    total += size
                    first, size = k + 1, 0
                if total >= CHUNK:
                    yield from _chunk_rows(number, pa.concat_arrays(ids), parts, LINKS, TEXTS, PAIRS)
                    ids, parts, total, number = [], [], 0, number + 1
        if parts:
            yield from _chunk_rows(number, pa.concat_arrays(ids), parts, LINKS, TEXTS, PAIRS)

    return rows.mapInArrow(encode, "chunk long, at long, pairs array<long>, n_pairs array<long>, body binary")


class _Known:
    """Takes the rows of chunks in order, the counts of a chunk's pairs before its texts, and gives the texts' sums of them."""

    def __init__(self) -> None:
        self._number: int | None = None
        self._values: list[np.ndarray] = []
        self._totals = self._best = np.zeros(0, np.int64)
        self._carried = np.zeros(3, np.int64)  # links, best ones and sum of a text's rows before its own

    def add(self, values: np.ndarray) -> None:
        """Counts of pairs, each twice that and one more for the best of their second id."""
        self._values.append(values)

    def texts(self, number: int, links: np.ndarray, n_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best links and sums of links' counts of the texts of a row, whose numbers of links are ``n_groups``."""
        if number != self._number:
            values = np.concatenate([*self._values, np.zeros(0, np.int64)])
            self._number, self._totals, self._best = number, values >> 1, values & 1
        self._values = []
        totals, best = self._totals[links], self._best[links]
        if not len(n_groups):
            self._carried += (len(links), best.sum(), totals.sum())
            return n_groups, n_groups
        first = np.zeros((3, len(n_groups)), np.int64)
        first[:, 0], self._carried = self._carried, np.zeros(3, np.int64)
        stops = np.cumsum(n_groups - first[0])
        starts = np.r_[0, stops[:-1]]
        good, upto = np.r_[0, np.cumsum(best)], np.r_[0, np.cumsum(totals)]
        return good[stops] - good[starts] + first[1], upto[stops] - upto[starts] + first[2]


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps and n_products.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a sentencepiece model. n_best counts links whose pair is the commonest of its second id (of
    equally common ones all are), n_products the pairs of tokens of a group. groups_sha256 is the digest of ``a1,a2|b1;a3|b2,b3``.
    """
    spark = docs.sparkSession
    with batches_of(spark, 1000):  # so that neither side holds many texts
        chunks = staged(_chunks(docs, path_a, path_b, id_col, text_col), "aligned", large_rows=True)
    listed = chunks.select("chunk", "at", F.posexplode(F.arrays_zip("pairs", "n_pairs")).alias("k", "x"))
    listed = listed.select("chunk", (F.col("at") + F.col("k")).alias("at"), F.col("x.pairs").alias("pair"), F.col("x.n_pairs").alias("n"))
    counts = listed.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % _IDS)
    counts = staged(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary at most
    counts = counts.join(F.broadcast(most), "b").select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    known = listed.select("chunk", "at", "pair").join(counts, "pair").select("chunk", "at", "value", F.lit(None).cast("binary").alias("body"))
    texts = chunks.where(F.col("body").isNotNull()).select("chunk", "at", F.lit(None).cast("long").alias("value"), "body")
    dealt = known.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "at").select("chunk", "value", "body")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products"]
    schema = f"id {docs.select(docs[id_col]).schema[0].dataType.simpleString()}, " + ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # this task encodes nothing
        known = _Known()
        for batch in batches:
            numbers, bodies, after = batch.column("chunk").to_numpy(), batch.column("body"), 0
            values = batch.column("value").fill_null(0).to_numpy()
            for row in np.flatnonzero(bodies.is_valid().to_numpy(zero_copy_only=False)).tolist():
                known.add(values[after:row])
                after = row + 1
                x = _unpacked(bodies[row].as_py())
                best, sums = known.texts(numbers[row], x["links"].to_numpy(), x["n_groups"].to_numpy())
                given = x | {"n_links": x["n_groups"], "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
                if len(best):
                    yield pa.RecordBatch.from_arrays([x["ids"], *(given[c] for c in names)], ["id", *names])
            known.add(values[after:].copy())  # so that the batch goes

    with batches_of(spark, 4000, 4 << 20):
        return staged(dealt.mapInArrow(count, schema).withColumnRenamed("id", id_col), "alignment")
