"""Scores of paragraphs by a pluggable scorer, each distinct text once."""

from __future__ import annotations

import hashlib
import json
import socket
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import staged
from ..functions.marks import chip, class_by_breakdown, class_by_score
from ..schemas import BREAKDOWN
from .cache import CacheTable, lookup

PARTS = ("human", "light", "heavy", "ai")


class Scorer(Protocol):
    """A model. ``rule`` says how a class is told: by cuts of the score, or by the largest part of the breakdown."""

    model_id: str
    rule: str

    def columns(self, text: Column) -> tuple[Column, Column] | None:
        """Score and breakdown as column expressions, if the model is one."""

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and an array of four parts for each text."""


class HashStubScorer:
    """Scores without meaning, from the digits of a hash: for testing the plumbing only, never to be read as a detection."""

    model_id, rule = "stub-md5", "score"

    def columns(self, text: Column) -> tuple[Column, Column]:
        digest = F.md5(text)
        number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("double")
        weights = [number(5 + 2 * k, 2) + 1 for k in range(4)]
        total = weights[0] + weights[1] + weights[2] + weights[3]
        return number(1, 4) / 65535.0, F.struct(*((w / total).alias(p) for p, w in zip(PARTS, weights, strict=True)))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        digests = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        weights = np.array([[int(d[4 + 2 * k : 6 + 2 * k], 16) + 1.0 for k in range(4)] for d in digests]).reshape(-1, 4)
        return np.array([int(d[:4], 16) / 65535.0 for d in digests]), weights / weights.sum(1, keepdims=True)


class OnnxScorer:
    """A model in ONNX files on every machine, named and pinned by a manifest.

    The manifest is JSON: model_id, and files with path, sha256 and bytes; "model" and "tokenizer" name two of them. Files are
    checked before any job and nothing is downloaded. Texts longer than ``max_tokens`` are never cut: with ``overlong="null"``
    they get no score (not a number, which becomes null) and the others of their batch do; with "raise" they end the job.
    """

    rule = "breakdown"

    def __init__(self, manifest: str, max_tokens: int = 512, overlong: str = "null") -> None:
        if overlong not in ("null", "raise"):
            raise ValueError("overlong must be null or raise")
        self.overlong = overlong
        self.folder, self.max_tokens = Path(manifest).parent, max_tokens
        self._path = Path(manifest)
        self.manifest = verified_manifest(manifest)
        self.model_id = self.manifest["model_id"]
        self._loaded: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}  # each worker loads its own

    def columns(self, text: Column) -> None:
        return None

    def ready(self, spark: SparkSession) -> int:
        return ready_everywhere(spark, str(self._path))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            model = onnxruntime.InferenceSession(str(self.folder / self.manifest["model"]), options, providers=["CPUExecutionProvider"])
            self._loaded = model, Tokenizer.from_file(str(self.folder / self.manifest["tokenizer"]))
        model, tokenizer = self._loaded
        encoded = [e.ids for e in tokenizer.encode_batch(texts)]
        fits = [k for k, x in enumerate(encoded) if len(x) <= self.max_tokens]
        if len(fits) < len(encoded) and self.overlong == "raise":
            raise ValueError(f"a text has more than {self.max_tokens} tokens; cut it into paragraphs first")
        score, parts = np.full(len(texts), np.nan), np.full((len(texts), 4), np.nan)
        if fits:
            longest = max(1, *(len(encoded[k]) for k in fits))
            ids, mask = np.zeros((len(fits), longest), np.int64), np.zeros((len(fits), longest), np.int64)
            for row, k in enumerate(fits):
                ids[row, : len(encoded[k])], mask[row, : len(encoded[k])] = encoded[k], 1
            logits = model.run(None, {"input_ids": ids, "attention_mask": mask})[0]
            shares = np.exp(logits - logits.max(1, keepdims=True))
            parts[fits] = shares / shares.sum(1, keepdims=True)
            score[fits] = parts[fits] @ np.arange(4) / 3
        return score, parts


def verified_manifest(path: str) -> dict:
    """The manifest, if all its files are there with the sizes and hashes that it states; raises otherwise."""
    manifest = json.loads(Path(path).read_text(encoding="utf-8"))
    for entry in manifest["files"]:
        file = Path(path).parent / entry["path"]
        if not file.is_file() or file.stat().st_size != entry["bytes"]:
            raise FileNotFoundError(f"{file} is missing or has another size than the manifest says")
        with file.open("rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != entry["sha256"]:
                raise ValueError(f"{file} isn't the file that the manifest pins")
    return manifest


def ready_everywhere(spark: SparkSession, manifest: str, tasks: int | None = None) -> int:
    """Check a manifest's files where tasks run: on every executor, before the first text is scored. Raises what is wrong where; gives the number of tasks.

    A barrier stage of as many tasks as run at once, so that every executor has some: all start together or none does.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        try:
            verified_manifest(manifest)
            wrong = ""
        except (OSError, ValueError, KeyError) as why:
            wrong = f"{socket.gethostname()}: {why}"
        yield pa.RecordBatch.from_arrays([pa.array([wrong])], ["wrong"])

    found = [r["wrong"] for r in spark.range(0, tasks, 1, tasks).mapInArrow(check, "wrong string", barrier=True).collect()]
    wrong = sorted({w for w in found if w})
    if wrong:
        raise ValueError("not ready: " + "; ".join(wrong))
    return len(found)


def score_texts(texts: DataFrame, scorer: Scorer) -> DataFrame:
    """Of (text_sha256, text), distinct: model_id, text_sha256, score, breakdown. Texts are dealt out anew, since a scan may be one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                score, parts = scorer.batch(part.column("text").to_pylist())
                none = np.isnan(score)
                breakdown = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(4)], names=list(PARTS), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([part.column("text_sha256"), pa.array(score.astype(float), mask=none), breakdown], ["text_sha256", "score", "breakdown"])

    if hasattr(scorer, "ready"):
        scorer.ready(texts.sparkSession)
    # texts of like length share a batch
    dealt = texts.select("text_sha256", "text").repartition("text_sha256").sortWithinPartitions(F.length("text"))
    return dealt.mapInArrow(run, f"text_sha256 string, score double, breakdown {BREAKDOWN}").select(F.lit(scorer.model_id).alias("model_id"), "text_sha256", "score", "breakdown")


def judged(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Rows with score and breakdown, with klass, chip and reason."""
    klass = class_by_score(F.col("score")) if scorer.rule == "score" else class_by_breakdown(F.col("breakdown"))
    known = F.col("score").isNotNull()
    reason = F.when(~known, "longer than the model takes")
    return rows.withColumns({"klass": F.when(known, klass), "chip": F.when(known, chip(F.col("score"))), "reason": reason})


def score_paragraphs(paragraphs: DataFrame, scorer: Scorer, cache: DataFrame | CacheTable | None = None) -> DataFrame:
    """Paragraphs with text_sha256, model_id, score, breakdown, klass, chip and reason.

    A paragraph that the model can't score has null in all but text_sha256 and model_id, and a reason, which is null for all others.

    A scorer that is an expression is one: no shuffle, no Python. Otherwise each distinct text that the cache doesn't
    hold is scored once, and scores are joined back by hash.
    """
    rows = paragraphs.withColumn("text_sha256", F.sha2("text", 256))
    native = scorer.columns(F.col("text"))
    if native is not None and cache is None:
        rows = rows.withColumns({"model_id": F.lit(scorer.model_id), "score": native[0], "breakdown": native[1]})
    else:
        rows = staged(rows, "paragraphs")  # looked at up to three times
        hits, misses = cache.lookup(rows, scorer.model_id) if isinstance(cache, CacheTable) else lookup(rows, cache, scorer.model_id)
        if native is not None:
            fresh = misses.select(F.lit(scorer.model_id).alias("model_id"), "text_sha256", native[0].alias("score"), native[1].alias("breakdown"))
        else:
            fresh = score_texts(misses, scorer)
        rows = rows.join(hits.unionByName(fresh), "text_sha256")
    return judged(rows, scorer)


SCORERS = {"stub": HashStubScorer, "onnx": OnnxScorer}


def scorer(backend: str = "stub", **options: str) -> Scorer:
    """The scorer of a backend, by name."""
    if backend not in SCORERS:
        raise ValueError(f"unknown backend {backend!r}; there are {sorted(SCORERS)}")
    return SCORERS[backend](**options)
