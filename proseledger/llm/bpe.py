"""Byte-pair encoding and decoding: merges by a priority queue over a doubly linked symbol list.

The tokenizer file is given by path and only read. Encoding and decoding follow the byte-level BPE that the file
describes: added tokens are matched first and as they stand, the rest is pre-tokenized, and each pre-token starts as
single bytes whose neighbours merge in order of rank, leftmost first.

Cases: a null text counts as the empty text and has no ids; very long texts are encoded whole (time grows as n log n);
repeated rows give repeated results; an empty table gives an empty one; extra columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pieces import PieceTable
from .shared import held, text_of

#: Fixed value: the pre-token pattern that the file's "ByteLevel" pre-tokenizer stands for.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free code point from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def check_byte_level(spec: dict, path: str) -> None:
    """Raise unless a tokenizer file is the plain byte-level BPE that cutting into pieces and byte lengths rely on."""
    pre = spec["pre_tokenizer"] or {}
    plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec["normalizer"] or spec["model"].get("dropout"):
        raise ValueError(f"{path} is not a plain byte-level BPE without a normalizer or a prefix space")


class BytePairCodec:
    """Encodes texts to ids and ids to texts with the vocabulary of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_byte_level(spec, path)
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self._byte_id = [0] * 256
        for c, b in letters.items():
            self._byte_id[b] = vocab[c]
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self._pretoken = regex.compile(BYTE_LEVEL_PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.table = PieceTable(lambda texts: [self._encode_plainly(t) for t in texts], tuple(self.added))

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token.

        Symbols form a doubly linked list by position. The queue holds (rank, position of the left symbol, both ids);
        an entry whose symbols have changed since it was pushed is stale and skipped.
        """
        ids = [self._byte_id[b] for b in data]
        n = len(ids)
        if n == 1:
            return ids
        rank = self._merge.get
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := rank((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := rank((merged, ids[k])):
                    heapq.heappush(queue, (m[0], i, merged, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := rank((ids[h], merged))):
                heapq.heappush(queue, (m[0], h, ids[h], merged, m[1]))
        return [x for x in ids if x >= 0]

    def _encode_plainly(self, text: str) -> bytes:
        out = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                out.extend(np.array(self.merge(word.encode()), "<u4").tobytes() for word in self._pretoken.findall(part))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.table.encode(text)

    def decode(self, ids: bytes) -> str:
        """The text of ids: the vocabulary's byte strings joined, bytes that are no UTF-8 replaced."""
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


def codec(path: str) -> BytePairCodec:
    """The codec of a file; it outlives a task in its worker process."""
    return held(("bpe", path), lambda: BytePairCodec(path))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids (array of int), ids_sha256, decoded_sha256 and, if asked for, the decoded text.

    No shuffle: each partition is encoded where it is read. ids_sha256 is of the ids as little-endian unsigned 32-bit
    integers, decoded_sha256 of the decoded text in UTF-8.
    """
    return _run(docs, path, id_col, text_col, ids=True, decoded=keep_text)


def digest_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_texts`, without the ids and texts themselves."""
    return _run(docs, path, id_col, text_col, ids=False, decoded=False)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, ids: bool, decoded: bool) -> DataFrame:
    rows = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256", *["decoded"] * decoded]
    kinds = {"id": kind, "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string", "decoded": "string"}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # few decoded texts at a time
                part = batch.slice(at, 500)
                blobs = bpe.table.encode_many(part.column("text").to_pylist())
                texts = [bpe.decode(b) for b in blobs]
                made = {
                    "id": part.column("id"),
                    "n_tokens": pa.array([len(b) // 4 for b in blobs], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                }
                if ids:
                    offsets = pa.array(np.cumsum([0, *(len(b) // 4 for b in blobs)]), pa.int32())
                    made["ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(blobs), "<u4").astype("i4")))
                if decoded:
                    made["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names)

    out = rows.mapInArrow(encode, ", ".join(f"{n} {kinds[n]}" for n in names))
    return out.withColumnRenamed("id", id_col)
