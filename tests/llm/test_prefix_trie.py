import hashlib
import random
import zlib
from collections import defaultdict

from comparing import same
from pyspark.sql import functions as F

from proseledger.llm import prefix_trie, queries
from proseledger.llm.prefix_trie import borrow_openings, ordered_turns
from proseledger.llm.running import running_sums

SCHEMA = "conv_id long, turn long, role string, text string, at long, key string, depth int, rank int, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def slow(rows, borrow=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if borrow else 0
        source = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(source, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved, size = (defaultdict(int) for _ in range(4))
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, m in members.items():
        own_saved = (len(m) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += own_saved
            size[path[:d]] += 1
    order = {p: k for k, p in enumerate(sorted(members, key=lambda p: [digest(*x) for x in p]))}
    out = []
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(path))))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(), order[path], order[path] + size[path]))
    return sorted(out, key=lambda r: r[8])


def got(turns, ids=None):
    out = prefix_trie.prefix_trie(*borrow_openings(turns)) if ids is None else prefix_trie.prefix_trie(turns, ids)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "preorder", "subtree_end"]
    return sorted(map(tuple, out.collect()), key=lambda r: r[8])


def test_op12_same_as_sql_and_brute_force(spark, sf):
    found = queries.op12_prefix_trie(spark, sf)
    same(spark, sf, lambda *_: found, queries.ORACLE_SQL["op12_prefix_trie"])
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[8]) == slow(rows)


def test_odd_rows(spark):
    rows = [(0, 1, "user", "a"), (0, None, None, None), (0, 1, "user", "a"), (0, 2, "", "é" * 5000), (1, 0, "x", "y"), (None, 0, "user", "lost"), (-3, 0, "u", "a"), (-3, 1, "u", "b"), (-5, 0, "u", "c"), (-5, 0, "t", "c"), (7, 0, "u", "a"), (8, 0, "1:u", "a"), (9, 0, "1", ":ua"), (13, 4, None, "z"), (12, 3, "u", "a")]
    assert got(ordered_turns(table(spark, rows))) == slow(rows)
    assert got(ordered_turns(table(spark, rows).where("1 = 0"))) == []
    assert got(ordered_turns(table(spark, [(None, 1, "a", "b")]))) == []


def test_random_conversations_of_any_length(spark):
    """Lengths over two levels of blocks, copies, openings of one another, one conversation with a third of the rows."""
    r = random.Random(1)
    convs = [[r.choice("abc") for _ in range(r.choice([1, 2, 5, 15, 16, 17, 33, 40]))] for _ in range(25)]
    convs += [r.choice(convs)[: r.randint(1, 40)] + [r.choice("ab")] * r.randint(0, 3) for _ in range(25)] + [r.choice(convs) for _ in range(15)]
    convs.append([r.choice("ab") for _ in range(400)])
    convs.append(convs[-1][:300])
    rows = [(c, t, "u", x) for c, v in enumerate(convs) for t, x in enumerate(v)]
    r.shuffle(rows)
    turns = ordered_turns(table(spark, rows).repartition(5))
    assert got(turns, turns.select("conv_id").distinct()) == slow(rows, borrow=False)
    assert got(turns) == slow(rows)


def test_running_sums_of_groups_over_several_tasks(spark):
    rows = [(g, k, (7 * k + g) % 11) for g, n in ((1, 3), (2, 500), (3, 1), (4, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, k long, w long").repartition(3)
    for group in ("g", None):
        want, sums = {}, defaultdict(int)
        for g, k, w in sorted(rows):
            want[g, k] = sums[g if group else 0]
            sums[g if group else 0] += w
        out = running_sums(df, ["g", "k"], ["w"], group)
        assert {(x.g, x.k): x.before_w for x in out.collect()} == want
    assert running_sums(df, ["g", "k"], ["w"], "g").select(F.spark_partition_id()).count() == len(rows)
