"""Benchmark decontamination: every passage of every document is a query to a BM25 index of the test items.

Passages are windows that overlap by half. Each item has its own: items of up to 64 words are looked for in windows of 128 words, those of up
to 256 in windows of 512, and so on by the factor 4, so that each item fits in one and no item widens those of others; an index
holds items of one such class. An item's impacts are divided by ``share`` of the score that it gets from its own words, so one threshold, 1, holds for all.

The index is searched by block-max WAND:

1. For all passages of a batch at once, terms are split in essential ones and others, whose impacts can't add up to more than
   a half in any item; the block maxima of a passage's essential terms and the most that the others can give are added
   up for each block, and passages without a block that reaches the threshold are done.
2. Every other passage walks its terms' lists in order of items. The pivot is the first item at which the largest impacts of
   the terms before and at it reach the threshold. If the block maxima there don't, all lists up to the pivot skip to
   the end of its block or to the next list's item; else the item is scored once all those lists stand at it.
3. All items that reach the threshold are retrieved. One counts if the passage holds enough of the word sequences of its
   question and of its answer (its last sentence, or the last third of a single one).

No term or passage is left out. Items with a null id can't be reported and so aren't searched for by :func:`find_items`; :func:`drop_contaminated`
needs no ids and searches for them too. An index holds at most ``index_items`` items and ``index_bytes`` bytes. With more, the items
are split; document frequencies and mean length are always those of all items, so that the split changes no result, and
``_AT_ONCE`` parts are searched in one pass over the documents.

Cases: ids of items are whole numbers (others raise); null texts count as empty; documents and items without words match nothing; equal items are reported each;
repeated documents give repeated rows; an empty table on either side gives no matches; further columns are not carried
by :func:`find_items` and all are kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let_go, staged, text_of

if TYPE_CHECKING:
    from pyspark import Broadcast

_K1, _B, _GRAM, _REACHED, _AT_ONCE = 1.2, 0.75, 5, 1 - 1e-9, 4
_LEAST_STRIDE = 64
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_SENTENCE = re.compile(r"[.?!]\s+")


def words_of(text: str) -> list[bytes]:
    """Lower-case words: letters and digits of ASCII and everything beyond it."""
    return text.lower().encode().translate(_TO_SPACE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    ends = [m.end() for m in _SENTENCE.finditer(text.strip())]
    question, answer = (words_of(text.strip()[: ends[-1]]), words_of(text.strip()[ends[-1] :])) if ends else ([], [])
    if not question or not answer:
        words = words_of(text)
        cut = max(1, len(words) * 2 // 3)
        question, answer = words[:cut], words[cut:]
    return question, answer


def _grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(_GRAM, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """The share of a part's word sequences that the passage holds; 1 for an empty part."""
    wanted = _grams(part)
    if not wanted:
        return 1.0
    n = min(_GRAM, len(part))
    return len(wanted.intersection(zip(*(passage[k:] for k in range(n)), strict=False))) / len(wanted)


class Statistics(NamedTuple):
    """Of all items with words, whichever index they are in."""

    items: int
    mean: float
    df: dict[bytes, int]


def statistics_of(bags: list[list[bytes]]) -> Statistics:
    bags = [b for b in bags if b]
    return Statistics(len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(t for b in bags for t in set(b)))


def stride_of(n_words: int) -> int:
    """Half the width of an item's passages: 64 words, or as many times 4 as the item needs."""
    stride = _LEAST_STRIDE
    while stride < n_words:
        stride *= 4
    return stride


class ItemIndex:
    """An inverted index of test items with block maxima; its passages are those of its longest item."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.6, block_items: int = 8, statistics: Statistics | None = None) -> None:
        found = [(i, words, text) for i, text in items if (words := words_of(text or ""))]
        found.sort(key=lambda x: (len(x[1]), x[0]))  # blocks hold items of like length
        self.item_ids = [i for i, _, _ in found]
        self.parts = [question_and_answer(text) for _, _, text in found]
        self.block_items = block_items
        of_all, mean, df_of_all = statistics or statistics_of([w for _, w, _ in found])
        self.stride = stride_of(max([0, *(len(w) for _, w, _ in found)]))
        bags = [Counter(w) for _, w, _ in found]
        df = Counter(t for bag in bags for t in bag)
        self.vocabulary = {t: n + 1 for n, t in enumerate(sorted(df))}  # 0: any other word
        idf = {t: float(np.log(1 + (of_all - df_of_all[t] + 0.5) / (df_of_all[t] + 0.5))) for t in df}
        postings: dict[int, list[tuple[int, float]]] = {n: [] for n in self.vocabulary.values()}
        for k, bag in enumerate(bags):
            length = sum(bag.values())
            own = {t: idf[t] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length / mean)) for t, tf in bag.items()}
            for t, impact in own.items():
                postings[self.vocabulary[t]].append((k, impact / (share * sum(own.values()))))
        spent, others = np.zeros(len(found)), np.zeros(len(self.vocabulary) + 1, bool)
        for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0])):
            mine = postings[self.vocabulary[t]]
            if all(spent[k] + x <= 0.5 for k, x in mine):
                others[self.vocabulary[t]] = True
                for k, x in mine:
                    spent[k] += x
        blocks = -(-len(found) // block_items)
        self.rest = np.array([spent[b * block_items : (b + 1) * block_items].max() for b in range(blocks)])
        self.essential = ~others
        self.essential[0] = False
        self.items = self._lists({t: x for t, x in postings.items()})
        maxima = {t: list({k // block_items: max(v for j, v in x if j // block_items == k // block_items) for k, _ in x}.items()) for t, x in postings.items()}
        self.maxima = self._lists(maxima)
        self.top = np.zeros(len(self.vocabulary) + 1)  # the largest impact of each term
        for t, x in postings.items():
            self.top[t] = max(v for _, v in x)

    def _lists(self, postings: dict[int, list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's list starts, and all lists' numbers and impacts."""
        at = np.zeros(len(self.vocabulary) + 2, np.int64)
        for t, x in postings.items():
            at[t + 1] = len(x)
        flat = [p for t in sorted(postings) for p in postings[t]]
        return np.cumsum(at), np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat], float)

    @staticmethod
    def _sums(lists: tuple[np.ndarray, np.ndarray, np.ndarray], passage: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Added impacts by passage * width + number."""
        at, number, impact = lists
        n = at[term + 1] - at[term]
        where = np.repeat(at[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, back = np.unique(np.repeat(passage, n) * width + number[where], return_inverse=True)
        return key, np.bincount(back, impact[where], len(key))

    def _block_bound(self, terms: list[int], block: int) -> float:
        """The most that the terms can give to an item of the block."""
        at, number, impact = self.maxima
        total = 0.0
        for t in terms:
            k = at[t] + np.searchsorted(number[at[t] : at[t + 1]], block)
            if k < at[t + 1] and number[k] == block:
                total += impact[k]
        return total

    def walk(self, terms: list[int]) -> list[tuple[int, float]]:
        """Numbers and scores of all items that a passage of these (distinct) terms brings to the threshold: block-max WAND."""
        at, number, impact = self.items
        # of each term its item, where its list stands, where it ends, the term
        lists = [[int(number[at[t]]), int(at[t]), int(at[t + 1]), t] for t in terms]
        found = []

        def move(one: list[int], item: int) -> None:
            one[1] += int(np.searchsorted(number[one[1] : one[2]], item))
            one[0] = int(number[one[1]]) if one[1] < one[2] else len(self.item_ids)

        while True:
            lists = sorted(x for x in lists if x[1] < x[2])
            most, pivot = 0.0, -1
            for k, one in enumerate(lists):
                most += self.top[one[3]]
                if most >= _REACHED:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            upto = lists[: pivot + 1]
            block = item // self.block_items
            if self._block_bound([x[3] for x in upto], block) < _REACHED:
                after = (block + 1) * self.block_items
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][0])
                for one in upto:
                    move(one, after)
            elif upto[0][0] < item:
                for one in upto:
                    if one[0] < item:
                        move(one, item)
            else:
                score = sum(float(impact[one[1]]) for one in upto)
                if score >= _REACHED:
                    found.append((item, score))
                for one in upto:
                    move(one, item + 1)

    def search(self, texts: list[str], least_question: float, least_answer: float) -> list[tuple[int, int, float, float, float]]:
        """(text, item id, score, overlap with the question, with the answer) of all items that a passage holds, each with the best such passage."""
        if not self.item_ids:
            return []
        known = self.vocabulary.get
        words = [words_of(t) for t in texts]
        ids = [np.fromiter((known(w, 0) for w in x), np.int64, len(x)) for x in words]
        # window k of a text holds its words from k * stride to (k + 2) * stride
        windows = np.array([max(1, -(-len(x) // self.stride)) for x in ids])
        base = np.cumsum(windows) - windows
        term = np.concatenate(ids)
        half = np.concatenate([b + np.arange(len(x)) // self.stride for b, x in zip(base, ids, strict=True)])
        first = np.repeat(base, [len(x) for x in ids])
        used = np.flatnonzero(term)
        term, half, first = term[used], half[used], first[used]
        earlier = half > first
        size = len(self.vocabulary) + 1
        pairs = np.unique(np.concatenate([half * size + term, (half[earlier] - 1) * size + term[earlier]]))
        passage, term = pairs // size, pairs % size
        blocks = len(self.rest)
        keep = self.essential[term]
        key, bound = self._sums(self.maxima, passage[keep], term[keep], blocks)
        left = np.unique(key[bound + self.rest[key % blocks] >= _REACHED] // blocks)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        starts, ends = np.searchsorted(passage, left), np.searchsorted(passage, left, "right")
        hits = [(window, item, s) for window, a, b in zip(left.tolist(), starts, ends, strict=True) for item, s in self.walk(term[a:b].tolist())]
        for window, item, s in hits:
            text = int(np.searchsorted(base, window, "right")) - 1
            start = (window - int(base[text])) * self.stride
            passage_words = words[text][start : start + 2 * self.stride]
            question, answer = (overlap(p, passage_words) for p in self.parts[item])
            if question < least_question or answer < least_answer:
                continue  # another passage may still hold the item
            best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (question + answer, question, s))
        return sorted((text, self.item_ids[item], s, q, both - q) for (text, item), (both, q, s) in best.items())


def _by_class(items: list[tuple[int, str]], share: float, statistics: Statistics | None = None) -> list[ItemIndex]:
    """An index for each class of lengths, all by the same statistics."""
    words = [words_of(text or "") for _, text in items]
    statistics = statistics or statistics_of(words)
    classes: dict[int, list[tuple[int, str]]] = {}
    for item, own in zip(items, words, strict=True):
        classes.setdefault(stride_of(len(own)), []).append(item)
    return [ItemIndex(own, share, statistics=statistics) for _, own in sorted(classes.items())]


def _indexes(items: DataFrame, item_id: str, item_text: str, share: float, index_items: int, index_bytes: int, nameless: bool) -> Iterator[list[ItemIndex]]:
    """The indexes of each part of the items; with ``nameless`` of those with a null id too, as if it were 0."""
    texts = items.select(F.col(item_id).cast("long").alias("i"), text_of(item_text).alias("t"))
    texts = texts.fillna(0, ["i"]) if nameless else texts.where(F.col("i").isNotNull())
    texts = texts.distinct()
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // index_items), -(-size["b"] // index_bytes))
    if parts == 1:
        yield _by_class([(r["i"], r["t"]) for r in texts.collect()], share)
        return
    texts = staged(texts.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int")), "test-items")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Part, term and number of words of each item's distinct terms; the item itself as the empty term."""
        for batch in batches:
            rows = [(part, t, len(words)) for part, text in zip(batch.column("part").to_pylist(), batch.column("t").to_pylist(), strict=True) if (words := words_of(text)) for t in {b"", *words}]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.int64()), strict=True)], ["part", "term", "words"])

    terms = staged(texts.select("part", "t").mapInArrow(bags, "part int, term binary, words long"), "test-terms")
    df = staged(terms.groupBy("term").agg(F.count("*").alias("n"), F.sum("words").alias("words")), "test-frequencies")
    whole = df.where(F.col("term") == F.lit(b"")).first()
    for part in range(parts):
        own = terms.where(F.col("part") == part).select("term").distinct().join(df, "term").select("term", "n")
        known = {bytes(r["term"]): r["n"] for r in own.collect()}  # as many as an index has terms
        if known:
            yield _by_class([(r["i"], r["t"]) for r in texts.where(F.col("part") == part).collect()], share, Statistics(whole["n"], whole["words"] / whole["n"], known))


def _passes(docs: DataFrame, indexes: Iterator[list[ItemIndex]]) -> Iterator[list[Broadcast]]:
    """Groups of parts that are searched in one pass, sent to all tasks; one of none if there are no items."""
    first = True
    while (group := [docs.sparkSession.sparkContext.broadcast(pickle.dumps(part)) for part in islice(indexes, _AT_ONCE)]) or first:
        first = False
        yield group


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.6, question: float = 0.6, answer: float = 0.5, index_items: int = 20_000, index_bytes: int = 32 << 20) -> DataFrame:
    """One row for each document and item that it holds: id, item_id, score (1: the threshold), question_overlap, answer_overlap. No shuffle."""
    rows = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for sent in _passes(docs, _indexes(items, item_id, item_text, share, index_items, index_bytes, nameless=False)):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            let_go()
            indexes = [index for x in sent for index in pickle.loads(x.value)]
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = part.column("text").to_pylist()
                    hits = sorted(hit for own in indexes for hit in own.search(texts, question, answer))
                    columns = list(zip(*hits, strict=True)) or [()] * 5
                    made = [part.column("id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])]
                    yield pa.RecordBatch.from_arrays(made, ["id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = rows.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.6, question: float = 0.6, answer: float = 0.5, index_items: int = 20_000, index_bytes: int = 32 << 20) -> DataFrame:
    """The documents that hold none of the items, with all their columns, whatever their names. No shuffle."""
    at_text, names = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*(f"k{n}" for n in range(len(names))))  # names with dots and the like don't get through
    for sent in _passes(docs, _indexes(items, item_id, item_text, share, index_items, index_bytes, nameless=True)):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            let_go()
            indexes = [index for x in sent for index in pickle.loads(x.value)]
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [t or "" for t in part.column(at_text).to_pylist()]
                    hit = {h[0] for own in indexes for h in own.search(texts, question, answer)}
                    yield part.filter(pa.array([k not in hit for k in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(search, docs.schema)
    return docs.toDF(*names)
