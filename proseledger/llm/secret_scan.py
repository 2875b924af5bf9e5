"""Secret scan: strings that a vocabulary of natural text can't say in few tokens, and three kinds told by their form.

The base kinds are assignments to a secret's name, access keys and hexadecimal strings. The kind "random" is the method's own: a run of
letters, digits and ``+/_-`` of some length is encoded with a tiktoken vocabulary, and if it has few characters to a
token it is taken for random. Before that, runs that are known digests (hexadecimal strings of the lengths of the usual hash functions,
integrity attributes) or identifiers (UUIDs, ULIDs, numbers, times, words and numbers with separators) are left out, and so are runs within a base
detection of an access key or hexadecimal string, which are reported already.

All texts are searched whole. RE2, in Arrow, tells the texts of a batch that can hold anything; only those are searched for places.

Cases: a null text counts as empty; an empty text has no spans; letters are told apart by case but in assignments, where only ASCII letters
have two; very long runs are encoded whole (the vocabulary's library takes n log n); repeated rows are scanned apart; an empty table gives an
empty one; further columns are not carried. Places are code points.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held, text_of

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
#: The base kinds. What fails the least length is consumed all the same.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: A run that may be random, and how few characters to a token make it so. Measured on random strings of 32 characters, 99 of 100
#: have at most 1.5 (letters and digits of both cases) to 2.0 (hexadecimal digits); words and names have 2.2 and more.
LEAST_RUN, FEW_CHARACTERS = 20, 2.0

#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile("|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_LENGTHS) + r"|sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}")
_IDENTIFIER = re.compile(
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"  # UUID
    r"|[0-7][0-9A-HJKMNP-TV-Z]{25}"  # ULID
    r"|[0-9+/_-]+"  # numbers
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9]{2}-?[0-9]{2}-?[0-9]{2}(?:[0-9]{3,9})?Z?(?:[-_][A-Za-z]{1,12})*"  # time
    r"|(?:[A-Za-z]{1,16}|[0-9]{1,8})(?:[/_-]+(?:[A-Za-z]{1,16}|[0-9]{1,8}))+[/_-]*"  # words and numbers with separators
)

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)  # ASCII: no letter from elsewhere counts as another case of these
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}")


def _any_case(pattern: str) -> str:
    """RE2 folds the case of letters beyond ASCII too, so names are spelled out as classes of two letters."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


_MAY_ASSIGN = "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]"""
_MAY_RUN = rf"[A-Za-z0-9+/_-]{{{LEAST_RUN}}}"


class TokenRatio:
    """Characters to a token under the vocabulary of a tiktoken file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> float:
        return len(text) / max(1, len(self._encoding.encode_ordinary(text)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    # what follows is one unbroken run, of which a shorter one can't pass, so the least length can stand in the pattern
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, ratio: TokenRatio, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same of random runs, but for those within an access key or hexadecimal string of ``known``."""
    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        if _DIGEST.fullmatch(run) or _IDENTIFIER.fullmatch(run) or any(kind and low <= m.start() and m.end() <= high for low, kind, high in known):
            continue
        if ratio.of(run) <= FEW_CHARACTERS:
            found.append((m.start(), 3, m.end()))
    return found


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, n_random, base_sha256 and spans. No shuffle.

    spans lists kind:start:end of all spans by start, then kind; base_sha256 is the digest of the base kinds' list.
    ``path`` and ``pattern`` are a tiktoken vocabulary and its pre-token pattern.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    none = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = held(("tiktoken", path), lambda: TokenRatio(path, pattern))
        for batch in batches:
            n = batch.num_rows
            counts, digests, spans = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n
            texts = batch.column("text")
            may = pc.or_(pc.match_substring_regex(texts, _MAY_RUN), pc.match_substring_regex(texts, _MAY_ASSIGN))
            for row in np.flatnonzero(may.to_numpy(zero_copy_only=False)).tolist():
                text = texts[row].as_py()
                base = base_spans(text)
                every = sorted(base + random_spans(text, ratio, base))
                for _, kind, _ in every:
                    counts[kind, row] += 1
                digests[row], spans[row] = hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)
            made = [batch.column("id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(made, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(scan, schema).select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
