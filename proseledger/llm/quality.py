"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words and pairs of following words, all of them, by their hashes (2^16 buckets of words and
2^15 of pairs; in scripts without spaces each character is a word). Further terms are the patterns of its writing: runs of
character classes (letters, capitals, digits, marks and so on) taken three at a time, pairs of classes, and how much its
words repeat. Counts are damped and weighted by inverse document frequency over all documents, so patterns that nearly all
documents have weigh little beside the words. A truncated singular value decomposition of the labelled sample gives the
latent axes: the sample's terms, at most ``max_labelled`` times ``DIMENSIONS`` numbers, are on the driver for that. The axes
and the labelled vectors are sent to all tasks (``axes`` numbers for each term, and for each of at most ``max_labelled``
documents); every document is compared with all of them in blocks of exact cosine products, and its nearest neighbours
vote with their labels, weighted by similarity. Neither labels, language, source nor ids enter a score.

Cases: a null text counts as empty; an empty text has no direction and gets the share of good labels; of equally near
neighbours (to a ten-thousandth) those with the smaller document id vote, so a score doesn't depend on the rows that are scored with it; null labels and labels of unknown documents are left out; without
any label the score is 0.5; repeated rows give repeated results; further columns are not carried.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, fresh_name, let_go, text_of

#: Marks with a class of their own; the rest of the classes are letters, capitals, digits, other ASCII and UTF-8 bytes.
_OWN_CLASS = (" ", "\n", ".", ",", "!", "|", "%#$&*@", "<>{}[]=;", "-_'\"()")
_REPEATS = 8
_GRID = 10_000  # similarities are told apart by a ten-thousandth
#: Patterns come first, then the buckets of words, then those of pairs of words.
_PATTERNS, _WORD_BITS, _PAIR_BITS = 4096 + 256 + 2 * _REPEATS, 16, 15
DIMENSIONS = _PATTERNS + (1 << _WORD_BITS) + (1 << _PAIR_BITS)
_NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_WORD = re.compile(f"[{_NO_SPACES}]|[^\\W{_NO_SPACES}]+")


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.uint8)
    table[[*range(ord("a"), ord("z") + 1)]] = 0
    table[[*range(ord("A"), ord("Z") + 1)]] = 1
    table[[*range(ord("0"), ord("9") + 1)]] = 2
    for n, marks in enumerate(_OWN_CLASS):
        table[[ord(c) for c in marks]] = 3 + n
    table[0x80:0xC0], table[0xC0:] = 12, 13
    return table


_CLASS = _classes()


def _patterns(text: str) -> np.ndarray:
    """Damped counts of the patterns of a text's writing; zero for a text without any."""
    out = np.zeros(_PATTERNS, np.float32)
    kind = _CLASS[np.frombuffer(text.encode(), np.uint8)].astype(np.int64)
    if len(kind) < 2:
        return out
    pairs = np.bincount(kind[:-1] * 16 + kind[1:], minlength=256)
    runs = kind[np.r_[True, kind[1:] != kind[:-1]]]
    if len(runs) > 2:
        threes = np.bincount(runs[:-2] * 256 + runs[1:-1] * 16 + runs[2:], minlength=4096)
        out[:4096] = np.sqrt(threes / threes.sum())
    out[4096:4352] = np.sqrt(pairs / pairs.sum())
    words = text.split()
    if len(words) > 8:
        # shares of words that stand twice in a row, and of pairs of words that stand in the text before
        twice = sum(map(str.__eq__, words, words[1:])) / len(words)
        again = 1 - len(set(zip(words, words[1:], strict=False))) / (len(words) - 1)
        for n, share in enumerate((twice, again)):
            out[4352 + n * _REPEATS + min(_REPEATS - 1, int(share * _REPEATS))] = 0.5 * min(1.0, share * 4)
    return out


def _damped(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(buckets, return_counts=True)
    return found, np.sqrt(n / max(1, len(buckets)))


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all terms of a text, ascending, and their damped counts."""
    patterns = _patterns(text)
    used = np.flatnonzero(patterns)
    hashes = np.array([crc32(w.encode()) for w in _WORD.findall(text.lower())], np.uint64)
    words, n_words = _damped((hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _WORD_BITS)).astype(np.int64))
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    pairs, n_pairs = _damped((pairs * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64))
    return np.concatenate([used, words + _PATTERNS, pairs + _PATTERNS + (1 << _WORD_BITS)]), np.concatenate([patterns[used], n_words, n_pairs]).astype(np.float32)


def features(text: str) -> np.ndarray:
    """The terms of a text as one vector; zero for a text without any."""
    out = np.zeros(DIMENSIONS, np.float32)
    number, value = terms(text)
    out[number] = value
    return out


@dataclass
class NeighbourVote:
    """A fitted classifier; what it holds is bounded by the sample and the number of axes."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = 25

    def project(self, counts: np.ndarray | list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Directions in the latent space, of vectors or of the terms of each text."""
        if isinstance(counts, list):
            latent = np.zeros((len(counts), self.axes.shape[1]), np.float32)
            for k, (number, value) in enumerate(counts):
                latent[k] = (value * self.idf[number]) @ self.axes[number]
        else:
            latent = (counts * self.idf) @ self.axes
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-9)

    def score(self, counts: np.ndarray | list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        vectors = self.project(counts)
        out = np.empty(len(counts))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(counts), 256):
            # rounded, so that a product's last bits, which depend on the other rows of a block, decide nothing
            near = np.rint((vectors[at : at + 256] @ self.vectors.T) * _GRID).astype(np.int64)
            # of equally near ones the first, which has the smaller id, ranks higher; the ranks of a row are all different
            rank = near * len(self.labels) - np.arange(len(self.labels))
            top = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
            weight = (np.maximum(np.take_along_axis(near, top, 1), 0) / _GRID) ** 2
            total = weight.sum(1)
            out[at : at + 256] = np.where(total > 1e-9, (weight * self.labels[top]).sum(1) / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def _leading_axes(rows: list[tuple[np.ndarray, np.ndarray]], axes: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of rows given by their terms, by subspace iteration from a fixed start."""
    used = np.unique(np.concatenate([number for number, _ in rows]))
    rows = [(np.searchsorted(used, number), value) for number, value in rows]

    def times(basis: np.ndarray) -> np.ndarray:
        return np.stack([value @ basis[number] for number, value in rows])

    def transposed_times(left: np.ndarray) -> np.ndarray:
        out = np.zeros((len(used), left.shape[1]), np.float32)
        for (number, value), row in zip(rows, left, strict=True):
            out[number] += value[:, None] * row
        return out

    width = min(axes + 16, len(rows), len(used))
    basis = np.random.default_rng(7).standard_normal((len(used), width)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(transposed_times(np.linalg.qr(times(basis))[0]))[0]
    _, _, right = np.linalg.svd(times(basis), full_matrices=False)
    out = np.zeros((DIMENSIONS, min(axes, width)), np.float32)
    out[used] = (basis @ right.T)[:, :axes]
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over all documents, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen[terms(text.as_py())[0]] += 1
                n += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[n, seen[used]])], ["term", "n"])

    sums = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(DIMENSIONS + 1, np.int64)
    for row in sums:  # at most as many rows as there are terms
        found[row["term"] + 1] = row["n"]
    return found[1:], int(found[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 2048, axes: int = 48, neighbours: int = 25) -> NeighbourVote:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of their ids; document frequencies are of all documents."""
    seen, n = document_frequencies(docs, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    # the sample is drawn from the labels, so that only so many ids are sent to the tasks that read the texts
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    sample = texts.join(F.broadcast(known), "_id").select("_id", "_label", "_text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [terms(t.as_py()) for t in batch.column("_text")]
            numbers, counts = (pa.array([x.tobytes() for x in part], pa.binary()) for part in ([n.astype(np.int32) for n, _ in made], [v for _, v in made]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), numbers, counts], ["_id", "_label", "numbers", "counts"])

    kind = sample.schema["_id"].dataType.simpleString()
    rows = sample.mapInArrow(describe, f"_id {kind}, _label {sample.schema['_label'].dataType.simpleString()}, numbers binary, counts binary").collect()
    rows.sort(key=lambda r: (r["_id"], r["numbers"], r["counts"]))
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 0.1
    if not rows:
        return NeighbourVote(idf, np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, neighbours)
    counts = [(np.frombuffer(r["numbers"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows]
    good = np.array([float(r["_label"] > 0) for r in rows])
    basis = _leading_axes([(number, value * idf[number]) for number, value in counts], axes)
    model = NeighbourVote(idf, basis, np.zeros((0, 1), np.float32), good, float(good.mean()), neighbours)
    model.vectors = model.project(counts)
    return model


def score_documents(docs: DataFrame, model: NeighbourVote, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and score. No shuffle."""
    return _scored(docs, model, [id_col], text_col, "score")


def keep_from(docs: DataFrame, model: NeighbourVote, cut: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns, whatever their names. No shuffle."""
    score = fresh_name(docs, "_score")
    return _scored(docs, model, docs.columns, text_col, score).where(F.col(score) >= cut).drop(score)


def _scored(docs: DataFrame, model: NeighbourVote, kept: list[str], text_col: str, score: str) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.select(*(column(docs, c).alias(f"k{n}") for n, c in enumerate(kept)), *([] if text_col in kept else [text_of(text_col).alias("text")]))
    kinds = [f"k{n} {rows.schema[f'k{n}'].dataType.simpleString()}" for n in range(len(kept))]
    at_text = kept.index(text_col) if text_col in kept else len(kept)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        fitted = pickle.loads(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores = fitted.score([terms(t.as_py() or "") for t in part.column(at_text)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(scores)], [*part.schema.names[: len(kept)], "score"])

    scored = rows.mapInArrow(vote, ", ".join([*kinds, "score double"]))
    return scored.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(kept)), F.col("score").alias(score))
