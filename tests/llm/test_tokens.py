import hashlib
import json
import lzma
import random
import zlib
from pathlib import Path

import numpy as np
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proseledger.llm import queries
from proseledger.llm.bpe import BytePairCodec, digest_texts, encode_texts
from proseledger.llm.id_coder import decode_block, encode_block
from proseledger.llm.library_encoder import LibraryEncoder, library_encoder
from proseledger.llm.pieces import PieceTable
from proseledger.llm.shared import shared_path
from proseledger.llm.token_counts import allocate, attribute_tokens, field_document, token_spans
from proseledger.llm.token_file import read_token_file, write_token_file

PIECES = ["a", "B", " ", "\n", "\t", "  ", "é", "'s", "'LL", "12", "½", "。", "\x1c", "　", "<|endoftext|>", "!!", "_", "\r\n", "日本", "😀", "́", "'", "the", "Word"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=20)


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def own(vocabulary):
    return BytePairCodec(vocabulary)


@given(TEXTS)
@settings(max_examples=1500, deadline=None)
def test_same_ids_as_the_library(library, own, vocabulary, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert library_encoder(vocabulary).encode(text).tolist() == ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_op7_on_real_and_odd_rows(spark, sf, library):
    for got, docs in ((queries.op7_bpe(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")), (digest_texts(odd.odd(spark), queries.vocabulary()), odd.odd(spark))):
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert digest_texts(odd.empty(spark), queries.vocabulary()).count() == 0


def test_ids_and_decoded_texts(spark, library):
    rows = encode_texts(odd.odd(spark).where(F.col("doc_id") == 8), queries.vocabulary(), keep_text=True).collect()
    assert rows[0].decoded == "é日本😀 <|endoftext|> x\t\t\ty" and rows[0].ids == library.encode(rows[0].decoded, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 40), max_size=300) | st.lists(st.integers(0, 9999), max_size=2000), st.integers(0, 2000))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids, more):
    ids = np.array(ids + ids[:more] + [0] * (more // 2), np.uint32)
    assert (decode_block(encode_block(ids, 10_000)) == ids).all()


def test_blocks_of_many_lanes_and_damage():
    ids = np.random.default_rng(3).zipf(1.3, 90_000) % 5000
    block = encode_block(ids, 5000)
    assert (decode_block(block) == ids).all() and len(block) < 1.5 * len(ids)
    for at in (0, 5, 30, len(block) // 2, len(block) - 40):
        bad = bytearray(block)
        bad[at] ^= 0x55
        with pytest.raises(ValueError, match="block"):
            decode_block(bytes(bad))
    for size in (0, 10, 60, len(block) // 2):
        with pytest.raises(ValueError, match="block"):
            decode_block(block[:size])


def test_blocks_use_their_contexts(spark, sf, vocabulary):
    """Far better than the ids' own frequencies, and than a general packer at its fastest."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").orderBy("doc_id").select("text").collect()
    ids = np.concatenate(library_encoder(vocabulary).encode_many([r.text or "" for r in docs]))
    block = encode_block(ids, 50_257)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    order_0 = -(share * np.log2(share)).sum()
    assert len(block) * 8 / len(ids) < order_0 - 1.5 and len(block) < 0.9 * len(lzma.compress(ids.tobytes(), preset=0))
    assert (decode_block(block) == ids).all()
    with pytest.raises(ValueError, match="vocabulary"):
        encode_block(ids, 1000)


def test_a_full_piece_table_changes_nothing(library):
    asked = []

    def batch(texts):
        asked.append(len(texts))
        return [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    texts = [f"one two{k % 7} three{k}\nfour  five {'long' * 20} {k}" for k in range(40)] + ["", "x", " lead", "\nfeed"]
    want = batch(texts)
    for room in (0, 2_000, 1 << 20):
        table = PieceTable(batch, limit_bytes=room)
        assert table.encode_many(texts) == want == table.encode_many(texts) and sum(180 + len(p) + len(b) for p, b in table.items()) <= room
        assert all(len(p) <= 64 for p in table)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}])
def test_other_tokenizers_are_refused(vocabulary, tmp_path, change):
    spec = json.loads(Path(vocabulary).read_text(encoding="utf-8")) | change
    (tmp_path / "t.json").write_text(json.dumps(spec))
    for make in (BytePairCodec, LibraryEncoder):
        with pytest.raises(ValueError, match="byte-level"):
            make(str(tmp_path / "t.json"))


def brute_file(rows, library):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [50, 1 << 22])
def test_token_file(spark, sf, library, vocabulary, block_ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for table in (docs, odd.odd(spark)):
        path = shared_path(spark, "test-file")
        write_token_file(table, path, vocabulary, block_ids=block_ids)
        got = sorted(map(tuple, read_token_file(spark, path).collect()), key=lambda r: r[1])
        assert got == brute_file([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], library)
    path = shared_path(spark, "test-file")
    write_token_file(odd.empty(spark), path, vocabulary)
    assert read_token_file(spark, path).count() == 0


def test_op3(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op3_token_file(spark, sf).collect()), key=lambda r: r[1]) == brute_file(rows, library)


def slow_counts(offsets, sections, rule):
    counts = [0.0] * (len(sections) + 1)
    for s, e in offsets:
        shared = [max(0, min(e, b) - max(s, a)) for a, b in sections]
        if rule == "start":
            at = next((k for k, (a, b) in enumerate(sections) if a <= s < b), -1)
            counts[at] += 1
        elif not sum(shared):
            counts[-1] += 1
        elif rule == "largest":
            counts[shared.index(max(shared))] += 1
        else:
            for k, n in enumerate(shared):
                counts[k] += n / sum(shared)
    return counts


@given(TEXTS, st.lists(st.integers(0, 30), max_size=8), st.sampled_from(["largest", "start", "share"]))
@settings(max_examples=300, deadline=None)
def test_allocation(vocabulary, library, text, cuts, rule):
    encoder = library_encoder(vocabulary)
    cuts = sorted({min(c, len(text)) for c in cuts})
    sections = list(zip(cuts, cuts[1:], strict=False))[::1]
    encoding = library.encode(text, add_special_tokens=False)
    starts, ends = token_spans(encoder.encode(text), text, encoder.n_bytes)
    first, last = (np.array([s[k] for s in sections], np.int64) for k in (0, 1))
    got = allocate(starts, ends, first, last, rule)
    want = slow_counts(list(zip(starts.tolist(), ends.tolist(), strict=True)), sections, rule)
    assert np.allclose(got, want) and abs(got.sum() - len(encoding.ids)) < 1e-9


def test_spans_cover_the_text(vocabulary, library):
    encoder = library_encoder(vocabulary)
    for text in ("plain words, here", "é日本😀 x", "ünï\n\ncödé", "日本語の文。\n😀😀 é<|endoftext|>é"):
        starts, ends = token_spans(encoder.encode(text), text, encoder.n_bytes)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == library.encode(text, add_special_tokens=False).offsets
        assert starts[0] == 0 and ends[-1] == len(text)


def brute_counts(doc, text, library):
    """The rows of a document with its lines as sections, from the library's own offsets."""
    encoding = library.encode(text or "", add_special_tokens=False)
    lines, at = [], 0
    for part in (text or "").split("\n"):
        lines.append((at, min(at + len(part) + 1, len(text or ""))))
        at += len(part) + 1
    lines = [x for x in lines if x[1] > x[0]]
    n = slow_counts(encoding.offsets, lines, "largest")
    rows = [(doc, k, "line", *span, int(n[k]), len(encoding.ids)) for k, span in enumerate(lines)]
    return rows if lines else [(doc, -1, None, 0, 0, 0, 0)]


def test_op1_as_brute_force(spark, sf, library):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd_docs = odd.odd(spark).where(F.length("text").isNull() | (F.length("text") < 1000))
    for docs, out in ((table, queries.op1_token_counts(spark, sf)), (odd_docs, attribute_tokens(odd_docs, queries.vocabulary()))):
        rows = docs.select("doc_id", "text").collect()
        assert any(not (r.text or "").isascii() for r in rows)
        want = [x for r in rows for x in brute_counts(r.doc_id, r.text, library)]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_fields_and_odd_rows(spark, vocabulary):
    docs = odd.odd(spark)
    text, sections = field_document(["source", "lang", "text"])
    rows = attribute_tokens(docs, vocabulary, sections, "start", text_col=text).collect()
    assert {r.name for r in rows} == {"source", "lang", "text", None}
    lines = attribute_tokens(docs, vocabulary)
    assert lines.where(F.col("section") == -1).count() == 2  # the null and the empty text
    assert attribute_tokens(odd.empty(spark), vocabulary).count() == 0
    none = attribute_tokens(docs, vocabulary, F.lit(None), "share").collect()
    assert {r.section for r in none} == {-1} and len(none) == docs.count()
    with pytest.raises(ValueError, match="rule"):
        attribute_tokens(docs, vocabulary, rule="other")


def test_words_and_marks_are_encoded_apart(vocabulary):
    """The library is given a word once, whatever marks follow it; ids stay those of whole texts."""
    encoder, library = LibraryEncoder(vocabulary), Tokenizer.from_file(vocabulary)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
    encoder.encode("".join(f"a vinganst{m} b" for m in marks))
    assert [p for p in encoder.table if "vinganst" in p] == ["vinganst"]
    rng = random.Random(4)
    parts = [*marks, "'", "'s", "'t", "9", "A", "z", "é", "×", "²", "٣", "字", "e\u0301", " ", " ", "\n", "\t", "\u3000", "\x85", "\u200b", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(5000)]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode_many(texts)] == want


class _Counting:
    """A tokenizer that notes which texts it is asked for."""

    def __init__(self, tokenizer):
        self._tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.asked += texts
        return self._tokenizer.encode_batch_fast(texts, **more)


def test_words_of_letters_need_no_pre_tokenizer(vocabulary):
    """The library's model is given pieces of letters as they stand; ids stay those of whole texts."""
    encoder, library = LibraryEncoder(vocabulary), Tokenizer.from_file(vocabulary)
    encoder._tokenizer = counting = _Counting(encoder._tokenizer)
    rng = random.Random(5)
    letters = [chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7)] + list("etaonrisz")
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(4000)]
    text = " ".join(words)
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert not counting.asked
    parts = [*words[:50], " ", "\n", "'s", "'", "×", "7", "字", "ª", "ʰ", "e\u0301", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in encoder.encode_many(texts)] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("plain", [False, True])
def test_added_tokens_inside_words(vocabulary, tmp_path, plain):
    spec = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    spec["added_tokens"].append({"id": len(spec["model"]["vocab"]) + 7, "content": "ing", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    (tmp_path / "t.json").write_text(json.dumps(spec))
    library = Tokenizer.from_file(str(tmp_path / "t.json"))
    text = "a singing king brings things\ningots"
    assert LibraryEncoder(str(tmp_path / "t.json"), plain).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_blocks_stay_as_they_were():
    """Files that were written before can be read: blocks have the same bytes, whatever way they are computed."""
    n = np.arange(300_000, dtype=np.uint64)
    hashed = (n * 2_654_435_761 >> 7) % 1_000_003
    for ids, crc in (((hashed * hashed >> 20) % 5000, 2067435617), (np.minimum(hashed % 7, n // 1000), 3201864057), (n[:40_000] % 40_000, 4226400893)):
        block = encode_block(ids.astype("<u4"), 50_257)
        assert zlib.crc32(block) == crc
        assert (decode_block(block) == ids).all()
