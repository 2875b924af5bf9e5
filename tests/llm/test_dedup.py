import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from comparing import same

from proseledger.llm import queries, shingles
from proseledger.llm.line_dedup import drop_spread_lines
from proseledger.llm.near_dup import components, keep_one, near_duplicates, samples_of, similarities, similarity
from proseledger.llm.shingles import Frequencies, plain_bands, substring_hashes


def test_substring_hashes_depend_on_the_substring_alone():
    a, b = b"xx the same words here yy", b"the same words here and much more after it"
    one = substring_hashes(np.frombuffer(a, np.uint8), np.array([3]), np.array([22]))
    two = substring_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([19]))
    assert a[3:22] == b[0:19] and one == two
    assert substring_hashes(np.frombuffer(b, np.uint8), np.array([1]), np.array([19])) != two


def test_shingles():
    h, n = shingles.shingles("A b c d e, f! a B C d E")
    assert n.sum() == 7 and n.max() == 2
    assert len(shingles.shingles("one two")[0]) == 1 and len(shingles.shingles(" .. ")[0]) == 0
    assert (shingles.shingles("one TWO")[0] == shingles.shingles("...One, two")[0]).all()


def test_samples_meet_as_often_as_similarity_says():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 2**63, 900, dtype=np.uint64))
    wa, wb = rng.uniform(1, 5, 700), rng.uniform(1, 5, 700)
    wb[:500] = wa[200:]  # of the shared ones most have equal weights
    wb[:100] *= 1.5
    a, b = samples_of(h[:700], wa, 2048), samples_of(h[200:], wb, 2048)
    shared = np.minimum(wa[200:], wb[:500]).sum()
    true = shared / (wa.sum() + wb.sum() - shared)
    assert abs((a == b).mean() - true) < 0.05


def test_block_similarities():
    seen = Frequencies(np.random.default_rng(1).integers(0, 50, (2, 1 << 20)), 1000)
    words = [f"w{k}" for k in range(60)]
    rng = random.Random(2)
    docs = []
    for _ in range(25):
        h, tf = shingles.shingles(" ".join(rng.choices(words[:12], k=rng.randint(0, 80))))
        docs.append((h, tf, seen.idf(h) if len(h) else np.zeros(0)))
    got = similarities(docs[:11], docs[11:])
    for x, y in itertools.product(range(11), range(14)):
        if len(docs[x][0]) and len(docs[11 + y][0]):
            assert abs(got[x, y] - similarity(docs[x], docs[11 + y])) < 1e-4


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 201), (200, 202), (200, 203), (300, 300)]
    links = spark.createDataFrame([(bytes([a % 256, a // 256]), bytes([b % 256, b // 256])) for a, b in edges], "a binary, b binary")
    sizes = sorted(r["count"] for r in components(links, "test").groupBy("label").count().collect())
    assert sizes == [1, 2, 4, 41]
    assert components(links.where("1 = 0"), "test").count() == 0


def near_copies(rng, n_groups, copies, words=150):
    """Groups of an original and edited copies, and more distant ones that only the original's neighbours are like."""
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for _ in range(n_groups):
        original = rng.choices(vocabulary, k=words)
        rows.append(original)
        for _ in range(copies):
            base = rng.choice(rows[-3:])
            text = base.copy()
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append(text)
    return [(k, " ".join(t)) for k, t in enumerate(rows)]


def runs_of_words(text):
    """Shingles of a text as strings, with counts."""
    words = re.findall("[a-z0-9\\x80-\U0010ffff]+", (text or "").lower())
    return Counter(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute_force(rows):
    """Distinct texts, their ids, and the weighted Jaccard similarity of every pair, from plain counts of strings.

    Only which rows are copies of others and so aren't counted is taken from the operator's bands.
    """
    bags, bands = [runs_of_words(t) for _, t in rows], [plain_bands(shingles.shingles(t or "")[0]).tolist() for _, t in rows]
    together = Counter(b for own in bands for b in own)
    counted = [bag for bag, own in zip(bags, bands, strict=True) if all(together[b] == 1 for b in own)]
    df = Counter(x for bag in counted for x in bag)
    weight = lambda x: math.log(1 + max(len(counted), 1) / max(df[x], 1))
    ids = defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    texts = [{x: n * weight(x) for x, n in runs_of_words(t).items()} for t in ids]
    total = [sum(x.values()) for x in texts]
    pairs = {}
    for a, b in itertools.combinations(range(len(texts)), 2):
        if shared := texts[a].keys() & texts[b].keys():
            both = sum(min(texts[a][x], texts[b][x]) for x in shared)
            pairs[a, b] = both / (total[a] + total[b] - both)
    return [*ids.values()], pairs


def classes_of(ids, links):
    up = list(range(len(ids)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        up[top(a)] = top(b)
    out = defaultdict(set)
    for k in range(len(ids)):
        out[top(k)].update(ids[k])
    return sorted(map(sorted, out.values()))


def check_classes(got, rows):
    """The same classes as by brute force; pairs within a hair of the threshold may be linked or not."""
    ids, pairs = brute_force(rows)
    want = {classes_of(ids, [p for p, s in pairs.items() if s >= 0.8 + d]).__repr__() for d in (-0.002, 0, 0.002)}
    assert repr(sorted(map(sorted, got.values()))) in want
    return sum(s >= 0.8 for s in pairs.values())


@pytest.mark.parametrize(("groups", "copies", "small", "chunk"), [(6, 12, 32, 256), (1, 90, 4, 16)])
def test_classes_as_brute_force(spark, groups, copies, small, chunk):
    rows = near_copies(random.Random(groups), groups, copies)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, ""), (1003, None)]
    docs = odd.table(spark, rows).repartition(5)
    got = defaultdict(list)
    for r in near_duplicates(docs, small=small, chunk=chunk, chunk_shingles=4_000).collect():
        got[r.class_id].append(r.doc_id)
    assert check_classes(got, rows) > 30
    kept = keep_one(docs, small=small, chunk=chunk)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(got)


def test_copies_do_not_count_in_frequencies(spark):
    """Half of all rows are copies of one text with a word changed in each; inverse frequencies of all rows would take them apart."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=120)
    rows = [(k, " ".join(rng.choices(words, k=100))) for k in range(300)]
    for k in range(300):
        text = base.copy()
        text[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 + k, " ".join(text)))
    got = defaultdict(list)
    for r in near_duplicates(odd.table(spark, rows)).collect():
        got[r.class_id].append(r.doc_id)
    check_classes(got, rows)
    assert max(map(len, got.values())) == 300
    alone = [k for k, v in got.items() if len(v) == 1]
    assert len(alone) == 300


def test_near_duplicates_of_odd_rows(spark):
    docs = odd.odd(spark)
    rows = near_duplicates(docs).collect()
    classes = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == docs.count()
    assert classes[1] == classes[2] == 1 and classes[4] == classes[5] == classes[6] == 4 and classes[7] == 7 and classes[None] is None and classes[3] == 3
    kept = sorted((r.doc_id for r in keep_one(docs).collect()), key=str)
    assert kept == sorted([1, 3, 4, 7, 8, 9, None, -4], key=str)
    assert near_duplicates(odd.empty(spark)).count() == keep_one(odd.empty(spark)).count() == 0


def test_op4_whole_table(spark, sf):
    """Against brute force over all pairs; of those at 0.8 or more, nine tenths at least must be in one class, and here all are."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got, label = defaultdict(list), {}
    for r in queries.op4_near_duplicates(spark, sf).collect():
        got[r.class_id].append(r.doc_id)
        label[r.doc_id] = r.class_id
        assert r.class_id <= r.doc_id
    check_classes(got, rows)
    ids, pairs = brute_force(rows)
    assert all(label[ids[a][0]] == label[ids[b][0]] for (a, b), s in pairs.items() if s >= 0.802)


def test_keep_one_of_rows_that_differ_in_null_alone(spark):
    docs = odd.table(spark, [(5, None), (5, ""), (6, odd.COPY), (6, odd.COPY)]).withColumnsRenamed({"n": "_own_key", "label": "_KEPT_id", "key": "_kept_key"})
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6]


def test_op5_same_as_sql(spark, sf):
    same(spark, sf, queries.op5_line_dedup, queries.ORACLE_SQL["op5_line_dedup"])


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            sites[line].add(s)
            first[line] = min(first.get(line, (i, k)), (i, k))
    spread = {x for x, s in sites.items() if x.strip(" ") and len(s - {None}) >= min_sites}
    return sorted((i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if x not in spread or first[x] == (i, k))) for i, t, _ in rows)


@pytest.mark.parametrize("min_sites", [1, 3, 10, 40])
def test_line_dedup_as_brute_force(spark, min_sites):
    rng = random.Random(min_sites)
    rows = [(k, "\n".join(f"line {int(rng.paretovariate(0.5)) % 60}" for _ in range(rng.randint(0, 9))), rng.choice([None, *(f"s{j}" for j in range(50))])) for k in range(400)]
    docs = odd.table(spark, rows).repartition(3)
    out = drop_spread_lines(docs, min_sites=min_sites)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == brute_lines(rows, min_sites)


def test_line_dedup_of_odd_rows(spark):
    docs = odd.odd(spark)
    out = drop_spread_lines(docs, min_sites=1, counts=True).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in out}
    assert texts[4] == odd.COPY and texts[5] == "" and texts[7] == "  \n\n " and texts[1] == "" and texts[-4] == "the\nsame\nlines"
    assert [r.text for r in out if r.doc_id == 6] == ["", ""]
    assert drop_spread_lines(odd.empty(spark)).count() == 0


def test_line_dedup_plan_has_no_python(spark, sf):
    plan = queries.op5_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_lines_take_linear_time(spark):
    """100,000 lines in a document, half of which go."""
    lines = {i: [f"shared {k}" if k % 2 else f"own {i} {k}" for k in range(100_000)] for i in (1, 2)}
    docs = odd.table(spark, [(i, "\n".join(x), f"s{i}") for i, x in lines.items()])
    began = time.monotonic()
    texts = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in drop_spread_lines(docs, min_sites=2, counts=True).collect()}
    assert time.monotonic() - began < 60
    assert texts[1] == ("\n".join(lines[1]), 100_000, 0) and texts[2] == ("\n".join(lines[2][::2]), 100_000, 50_000)


def test_line_dedup_keeps_columns_of_any_name(spark):
    docs = odd.table(spark, [(k, "same\nown %d" % k, f"s{k}") for k in range(3)]).withColumnsRenamed({"n": "_gone_id", "label": "_STAYS", "key": "_gone_text", "bucket": "gone"})
    out = drop_spread_lines(docs, min_sites=3)
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == ["own 1", "own 2", "same\nown 0"]
