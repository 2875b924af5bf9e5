"""Token counts of parts of documents, by the character offsets of tokens.

The ids of each document are those that the library gives for the whole text (see ``library_encoder`` for how they are
made). A token's character span follows from the bytes that the tokens before it stand for; the spans are then joined with
the spans of the document's sections (both are sorted, so the interval join is two binary searches for each token). A token
that crosses a boundary is allocated by one of the rules:

- ``largest``: to the section that holds most of its characters, of equals the earlier one;
- ``start``: to the section that holds its first character;
- ``share``: to every section it touches, in proportion to the characters there.

A character that several tokens stand for (bytes of one code point) belongs to each of them in full.

Cases: a null text counts as empty; an empty text and a null or empty list of sections give one row with section -1
and 0 tokens or all tokens; tokens of which no character is in a section are counted under section -1 (the row is left
out if there are none and the document has sections); sections must not overlap; long texts are handled whole; repeated
rows give repeated results; extra columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .library_encoder import library_encoder
from .shared import text_of

RULES = ("largest", "start", "share")


def field_document(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """One text of several columns, and the section of each in it."""
    parts = [text_of(c) for c in fields]
    text = F.concat_ws(separator, *parts)
    spans, at = [], F.lit(0)
    for name, part in zip(fields, parts, strict=True):
        end = at + F.length(part)
        spans.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(separator)
    return text, F.array(*spans)


def token_spans(ids: np.ndarray, text: str, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one code point of each token."""
    ends = np.cumsum(n_bytes[ids])
    starts = ends - n_bytes[ids]
    if not text.isascii():
        chars = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        starts, ends = chars[starts] - 1, chars[ends - 1]
    return starts, ends


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, each with the line feed that ends it."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feeds, at = [], text.find("\n")
    while at >= 0:
        feeds.append(at + 1)
        at = text.find("\n", at + 1)
    if not feeds or feeds[-1] < len(text):
        feeds.append(len(text))
    return np.array([0, *feeds[:-1]], np.int64), np.array(feeds, np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [first, last), and at the end those of none. Sections are in order and don't overlap."""
    n = len(first)
    counts = np.zeros(n + 1)
    if not n or not len(starts):
        counts[n] = len(starts)
        return counts
    lo = np.searchsorted(last, starts, "right")
    hi = np.searchsorted(first, ends, "left") - 1
    one, many = hi == lo, hi > lo
    if rule == "start":
        inside = (lo < n) & (first[np.minimum(lo, n - 1)] <= starts)
        return np.bincount(np.where(inside, lo, n), minlength=n + 1).astype(float)
    counts += np.bincount(np.where(one, lo, n)[~many], minlength=n + 1)
    for t in np.flatnonzero(many):  # few: tokens that touch two sections or more
        s = np.arange(lo[t], hi[t] + 1)
        shared = np.minimum(last[s], ends[t]) - np.maximum(first[s], starts[t])
        if rule == "largest":
            counts[s[np.argmax(shared)]] += 1
        else:
            counts[s] += shared / shared.sum()
    return counts


def attribute_tokens(docs: DataFrame, path: str, sections: str | Column = "lines", rule: str = "largest", id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """One row for each section: id, section (from 0), name, start, end (code points), n_tokens, doc_tokens.

    ``sections`` is "lines", or a column of array<struct<name, start, end>>. n_tokens is whole but under ``share``.
    No shuffle: documents are encoded where they are read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    by_line = isinstance(sections, str)
    text = text_of(text_col) if isinstance(text_col, str) else text_col
    spans = F.lit(None).cast("array<struct<name:string,start:int,end:int>>") if by_line else sections.cast("array<struct<name:string,start:int,end:int>>")
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), spans.alias("spans"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, section int, name string, start int, end int, n_tokens double, doc_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "section", "name", "start", "end", "n_tokens", "doc_tokens")}
            given = [None] * batch.num_rows if by_line else batch.column("spans").to_pylist()
            texts = batch.column("text").to_pylist()
            for row, (doc, own, ids) in enumerate(zip(texts, given, encoder.encode_many(texts), strict=True)):
                names = None
                if by_line:
                    first, last = line_spans(doc)
                else:
                    own = sorted((x for x in own or [] if x), key=lambda x: (x["start"], x["end"]))
                    first, last = (np.array([x[k] for x in own], np.int64) for k in ("start", "end"))
                    names = [x["name"] for x in own]
                    if (first[1:] < last[:-1]).any():
                        raise ValueError("sections overlap")
                n = allocate(*token_spans(ids, doc, encoder.n_bytes), first, last, rule)
                keep = len(first) + int(not len(first) or n[-1] > 0)
                out["row"].append(np.full(keep, row))
                out["section"].append(np.r_[np.arange(len(first)), -1][:keep])
                out["name"].extend([*(names or ["line"] * len(first)), None][:keep])
                out["start"].append(np.r_[first, 0][:keep])
                out["end"].append(np.r_[last, len(doc)][:keep])
                out["n_tokens"].append(n[:keep])
                out["doc_tokens"].append(np.full(keep, len(ids)))
            if not batch.num_rows:
                continue
            row, section, start, end, n_tokens, doc_tokens = (np.concatenate(out[k]) for k in ("row", "section", "start", "end", "n_tokens", "doc_tokens"))
            made = [batch.column("id").take(pa.array(row)), pa.array(section.astype("i4")), pa.array(out["name"], pa.string()), pa.array(start.astype("i4")), pa.array(end.astype("i4")), pa.array(n_tokens.astype(float)), pa.array(doc_tokens.astype("i8"))]
            yield pa.RecordBatch.from_arrays(made, ["id", "section", "name", "start", "end", "n_tokens", "doc_tokens"])

    out = rows.mapInArrow(count, schema)
    return (out if rule == "share" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))).withColumnRenamed("id", id_col)
