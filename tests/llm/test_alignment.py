import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proseledger.llm import alignment, queries
from proseledger.llm.alignment import PieceEncoder, align, align_tokens, group_products
from proseledger.llm.bpe import byte_letters

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "B", " ", "  ", "   ", "\n", "\t", "é", "'s", "12", "½", "。", "　", "<s>", "<unk>", "<|endoftext|>", "<0x41>", "!!", "_", "\r\n", "日本", "😀", "́", "the", "Word", "▁", "\x00", "¶"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=20)


@pytest.fixture(scope="module")
def tokenizers(vocabulary):
    a, b = Tokenizer.from_file(vocabulary), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    letters = byte_letters()

    def side_a(text):
        e = a.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]

    def side_b(text):
        out = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return side_a, side_b


def slow(rows, tokenizers):
    docs = []
    for doc, text in rows:
        a, b = ([], []) if not text else (tokenizers[0](text), tokenizers[1](text))
        if text and not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            a = b = []
        at, ends = 0, []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            ends.append(own)
        shared = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        groups = [([], []) for _ in shared]
        for side, own in enumerate(ends):
            for _, e, i in own:
                groups[bisect_left(shared, e)][side].append(i)
        last = {e: i for _, e, i in ends[1]}
        links = [(i, last[e]) for _, e, i in ends[0] if e in last]
        overlaps = sum(s < f and t < e for s, e, _ in ends[0] for t, f, _ in ends[1]) if len(a) < 150 else None
        docs.append((doc, a, b, groups, links, overlaps))
    counts = Counter(x for d in docs for x in d[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc, a, b, groups, links, overlaps in docs:
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        n_best, total = sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((doc, len(a), len(b), len(groups), len(links), n_best, total, digest, overlaps, sum(len(g) * len(h) for g, h in groups)))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products"]


def compare(found, want):
    got = [tuple(r[c] for c in COLUMNS) for r in found.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:8])
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x == (*y[:8], x[8] if y[8] is None else y[8], y[9])


def test_op11_against_brute_force(spark, sf, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compare(queries.op11_alignment(spark, sf), slow(rows, tokenizers))


def test_odd_rows_and_several_chunks(spark, tokenizers, vocabulary, monkeypatch):
    more = [(20, " lead"), (21, "two  spaces and   three"), (22, "trail "), (23, "▁ mark"), (24, "<s> <unk> <|endoftext|>"), (25, "\n\n a \n b"), (26, "the word the word"), (27, "the word"), (28, "a\x00b\tc"), (29, " ")]
    docs = odd.table(spark, odd.odd_rows() + more).repartition(1)
    want = slow([(r.doc_id, r.text) for r in docs.collect()], tokenizers)
    compare(align_tokens(docs, vocabulary, MODEL), want)
    monkeypatch.setattr(alignment, "PART", 20)
    monkeypatch.setattr(alignment, "CHUNK", 60)
    compare(align_tokens(docs.withColumnRenamed("text", "a.b"), vocabulary, MODEL, text_col="`a.b`"), want)
    assert align_tokens(odd.empty(spark), vocabulary, MODEL).count() == 0
    zeros = [r for r in align_tokens(docs, vocabulary, MODEL).collect() if r.doc_id in (1, 2, 23)]
    assert len(zeros) == 3 and all(r.n_a == r.n_b == r.n_groups == r.n_links == r.count_sum == 0 and r.groups_sha256 == "" for r in zeros)


def test_small_rows_of_a_chunk(spark, tokenizers, vocabulary, monkeypatch):
    long = [(40, "the word and words, " * 30), (41, "a"), (42, None), (43, "é" * 25 + " the word\n" * 9), (44, "the Word!! "), (45, "x  y" * 20)]
    docs = odd.table(spark, long + odd.odd_rows() + long).repartition(1)
    want = slow([(r.doc_id, r.text) for r in docs.collect()], tokenizers)
    for name, value in {"LINKS": 7, "TEXTS": 2, "PAIRS": 3}.items():
        monkeypatch.setattr(alignment, name, value)
    compare(align_tokens(docs, vocabulary, MODEL), want)
    monkeypatch.setattr(alignment, "PART", 50)
    monkeypatch.setattr(alignment, "CHUNK", 700)
    compare(align_tokens(docs, vocabulary, MODEL), want)


def test_no_row_of_a_chunk_is_large(spark, vocabulary):
    rng = np.random.default_rng(1)
    words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 9, 9000)])
    texts = [" ".join(words[rng.integers(0, 9000, n)]) for n in (200_000, 30_000, 30_000, *[1000] * 60)]
    chunks = alignment._chunks(odd.table(spark, [*enumerate(texts), *((k, "") for k in range(100, 4000))]).repartition(1), vocabulary, MODEL, "doc_id", "text").toArrow()
    assert sum(map(len, texts)) > 1_500_000
    assert max(chunks.slice(k, 1).nbytes for k in range(len(chunks))) < 600_000


@given(TEXTS)
@settings(max_examples=1500, deadline=None)
def test_pieces_are_those_of_the_whole_text(text):
    model = encoder()._model
    ids = np.frombuffer(encoder().table.encode(" " + text), "<u4").tolist()
    if alignment._LOST in ids:
        assert b"".join(encoder().token_bytes[i] for i in model.encode(text)) != (" " + text).encode()
    else:
        assert ids == (model.encode(text) or [model.piece_to_id("▁")])


_encoder = []


def encoder():
    if not _encoder:
        _encoder.append(PieceEncoder(MODEL))
    return _encoder[0]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_intervals(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    end = max(a[-1], b[-1])
    a, b = (x if x[-1] == end else np.r_[x, end] for x in (a, b))
    x = align(a, b)
    spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in (a, b)]
    assert list(zip(x.overlap_a, x.overlap_b, strict=True)) == sorted((i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e)
    assert x.groups.tolist() == sorted({*a.tolist()} & {*b.tolist()})
    assert group_products(x).sum() >= len(x.overlap_a)
