"""A file of token ids in document order, in blocks of an adaptive range coder, and its reader.

The file is a Parquet table, so that a lost executor only repeats its own part and readers prune what they don't need:

    part long        number of the range of ids that the block lies in, ascending
    block long       number of the block within its part, ascending
    first long       ids of the part before the block
    n_ids long       ids of the block
    doc_ids array    documents of the block, in order
    n_tokens array   ids of each of them, end id included
    payload binary   the block, as ``id_coder.encode_block`` writes it: independent, with a checksum

Blocks hold whole documents and close at ``block_ids`` ids, so one is never larger than that and its last document.

Cases: a null text counts as empty and has the end id alone; null ids come first; rows with equal ids keep the order of
their texts; an empty table gives an empty file; a damaged block raises ValueError; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .id_coder import decode_block, encode_block
from .library_encoder import library_encoder
from .shared import text_of

SCHEMA = "part long, block long, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


def write_token_file(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_ids: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the whole texts with the tokenizers library and write their ids, in ascending order of ``id_col``.

    One shuffle: the texts are dealt out by ranges of ids. Each task streams its range, a block at a time.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = library_encoder(vocabulary), TaskContext.get().partitionId()
        size = max(end_id + 1, len(encoder.n_bytes))
        end = np.array([end_id], "<u4")
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        lengths: list[int] = []
        block = first = n = 0

        def close() -> pa.RecordBatch:
            payload = encode_block(np.concatenate(held), size)
            made = [[number], [block], [first], [n], [ids], [lengths], [payload]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "first", "n_ids", "doc_ids", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = encoder.encode_many(part.column("text").to_pylist())
                for doc, own in zip(part.column("id").to_pylist(), found, strict=True):
                    held += [own, end]
                    ids.append(doc)
                    lengths.append(len(own) + 1)
                    n += len(own) + 1
                    if n >= block_ids:
                        yield close()
                        block, first, n, held, ids, lengths = block + 1, first + n, 0, [], [], []
        if ids:
            yield close()

    ordered.mapInArrow(encode, SCHEMA).write.parquet(path)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document, from the file alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    ids_crc32 is unsigned, of the document's ids as little-endian unsigned 32-bit integers.
    """
    table = spark.read.schema(SCHEMA).parquet(path)
    # one row for each part of the file, so the running sum is short
    starts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    schema = "part long, rel long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                ids = decode_block(x["payload"])
                lengths = np.array(x["n_tokens"], np.int64)
                if len(ids) != x["n_ids"] or lengths.sum() != len(ids):
                    raise ValueError("damaged block: its documents don't fit")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                made = [pa.array(np.full(len(lengths), x["part"])), pa.array(x["first"] + ends - lengths), pa.array(x["doc_ids"], pa.int64()), pa.array(lengths), pa.array(crcs, pa.int64())]
                names = ["part", "rel", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype("i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(made, names)

    docs = table.select("part", "first", "n_ids", "doc_ids", "n_tokens", "payload").mapInArrow(decode, schema)
    columns = ["doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return docs.join(starts, "part").select(*columns)
