"""Prefix trie of conversations: the nodes are the distinct openings that conversations share, numbered so that a subtree is an interval.

Conversations are ranked by their turns, compared one turn after the other (by a digest of role and text), an opening before what
continues it. A node is then the first of its members' ranks and its depth, and in the order of (rank, depth) every subtree stands together:
a node's number is its place in that order and its subtree ends where the first conversation behind its members begins. Leaves and
savings of a subtree are differences of running sums over that order.

Nothing is gathered by conversation or by node: places and sums come from ``running``, conversations are compared in blocks of 16 turns
that are numbered in order, then in blocks of 16 numbers and so on, and a node's conversations are hashed as a stream.

Cases: rows with a null conv_id belong to no conversation; a null turn comes first; of equal turns that with the smaller digest comes first,
and equal rows are turns of their own; null roles and texts are empty ones; an empty table has no nodes, not even the root; texts of any length are
one digest; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums
from .shared import staged, text_of

#: Turns, and then numbers of blocks, that are compared at once.
BLOCK = 16
#: Numbers that stand for an opening, of 31 bits each, so that sums of billions of turns fit a long.
_LANES = 4
#: A node's conversations are handed on in texts of about so many characters.
_CHUNK = 1 << 16


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, at (0 for the first turn), key (a digest of role and text) and n_bytes of the text."""
    role, text = text_of(role_col), text_of(text_col)
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.where(F.col("conv_id").isNotNull()).withColumns({"one": F.lit(1).cast("long"), "row": F.monotonically_increasing_id()})
    return running_sums(staged(rows, "turns"), ["conv_id", "turn", "key", "row"], ["one"], "conv_id").select("conv_id", F.col("before_one").alias("at"), "key", "n_bytes")


def borrow_openings(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another does: turns, and the ids of all conversations, those left without turns too.

    Conversation c gets the first h turns of conversation c - c % ``every`` in place of its own first h, h being the checksum of c modulo ``most``.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("last"))
    first = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    convs = sizes.select("conv_id", first, (F.col("conv_id") - F.col("conv_id") % every).alias("source"), "last")
    lent = sizes.select(F.col("conv_id").alias("source"), (F.col("last") + 1).alias("lent"))
    convs = staged(convs.join(lent, "source", "left").select("conv_id", "source", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("n")), "conversations")
    own = turns.join(convs.select("conv_id", "h", "n"), "conv_id").where(F.col("at") >= F.col("h")).select("conv_id", (F.col("at") - F.col("h") + F.col("n")).alias("at"), "key", "n_bytes")
    openings = turns.where(F.col("at") < most).withColumnRenamed("conv_id", "source")
    borrowed = openings.join(convs.select("conv_id", "source", "h"), "source").where(F.col("at") < F.col("h")).select("conv_id", "at", "key", "n_bytes")
    return staged(own.unionByName(borrowed), "rebuilt"), convs.select("conv_id")


def _block_keys(turns: DataFrame) -> DataFrame:
    """conv_id and key of every conversation with turns; the order of keys is that of the sequences."""
    longest = turns.agg(F.max("at")).first()[0] or 0
    blocks = turns.select("conv_id", "at", "key")
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]), "")
        blocks = blocks.groupBy("conv_id", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(joined.alias("key")).withColumnRenamed("block", "at")
        if longest < BLOCK:
            return blocks.select("conv_id", "key")
        longest //= BLOCK
        blocks = staged(blocks, "blocks")
        distinct = staged(blocks.select("key").distinct().withColumn("one", F.lit(1).cast("long")), "distinct-blocks")
        numbers = running_sums(distinct, ["key"], ["one"]).select("key", F.lpad(F.hex(F.col("before_one")), 16, "0").alias("number"))
        blocks = blocks.join(numbers, "key").select("conv_id", "at", F.col("number").alias("key"))


def _lanes(key: Column, at: Column) -> list[Column]:
    digest = F.md5(F.concat(key, at.cast("string")))
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF) for k in range(_LANES)]


def _ends(ranked: DataFrame) -> DataFrame:
    """rank (of the first of them) and ends_sha256 of the ids of all conversations that are the same."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, ranks = (batch.column(c) for c in ("key", "conv_id", "rank"))
            if not len(keys):
                continue
            numbers = keys.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            at, texts = [], []
            for start, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
                for low in range(start, stop, _CHUNK // 8):
                    at.append(low)
                    texts.append(",".join(map(str, ids[low : min(stop, low + _CHUNK // 8)].to_pylist())))
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([keys.take(at), ranks.take(at), pa.array(texts, pa.string())], ["key", "rank", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = digest = None
        for batch in batches:
            ranks, found = [], []
            for own, rank, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "rank", "ids")), strict=True):
                if own == key:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    ranks.append(first)
                    found.append(digest.hexdigest())
                key, first, digest = own, rank, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(found, pa.string())], ["rank", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([digest.hexdigest()])], ["rank", "ends_sha256"])

    parts = ranked.repartitionByRange("rank").sortWithinPartitions("rank").mapInArrow(chunks, "key string, rank long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "rank").mapInArrow(digests, "rank long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end.

    ``turns`` has conv_id, at (gapless from 0), key and n_bytes; ``ids`` the conv_id of all conversations. n_leaves and saved_tokens
    are sums over the node's subtree, [preorder, subtree_end); what a node saves itself is n_bytes of its last turn for each member but one.
    ends_sha256 is the digest of the ids, ascending and joined by commas, of the members that have no further turn.
    """
    one = F.lit(1).cast("long")
    keyed = ids.join(_block_keys(turns), "conv_id", "left").select("conv_id", F.coalesce("key", F.lit("")).alias("key"), one.alias("one"))
    ranked = staged(running_sums(staged(keyed, "sequences"), ["key", "conv_id"], ["one"]).select("conv_id", "key", F.col("before_one").alias("rank")), "ranks")
    n_convs = ranked.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where(F.col("n_convs") > 0)

    names = [f"lane{k}" for k in range(_LANES)]
    laned = turns.select("conv_id", "at", "n_bytes", *(x.alias(n) for x, n in zip(_lanes(F.col("key"), F.col("at")), names, strict=True)))
    paths = running_sums(staged(laned, "lanes"), ["conv_id", "at"], names, "conv_id").join(ranked.select("conv_id", "rank"), "conv_id")
    upto = [(F.col(n) + F.col(f"before_{n}")).alias(n) for n in names]
    above = [F.col(f"before_{n}").alias(f"above_{n}") for n in names]
    paths = paths.select("conv_id", "rank", "n_bytes", (F.col("at") + 1).alias("depth"), *upto, *above)
    nodes = paths.groupBy("depth", *names).agg(F.min("conv_id").alias("conv_id"), F.min("rank").alias("rank"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), *(F.min(f"above_{n}").alias(f"above_{n}") for n in names))
    zero = F.lit(0).cast("long")
    root = n_convs.select(zero.alias("depth"), *(zero.alias(n) for n in names), "conv_id", zero.alias("rank"), "n_convs", zero.alias("n_bytes"), *(F.lit(None).cast("long").alias(f"above_{n}") for n in names))
    nodes = staged(nodes.unionByName(root), "nodes")

    parents = [(F.col("depth") - 1).alias("depth"), *(F.col(f"above_{n}").alias(n) for n in names)]
    children = nodes.where(F.col("depth") > 0).select(*parents).groupBy("depth", *names).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", *names], "left").withColumn("n_children", F.coalesce("n_children", zero))
    up = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(n).alias(f"above_{n}") for n in names), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(up, ["depth", *(f"above_{n}" for n in names)], "left")
    weighed = nodes.select("rank", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", one.alias("node"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    # at each rank, before its nodes, a mark; one more behind the last
    empty = {c: F.lit(None).cast("long") for c in ("conv_id", "parent_conv_id", "n_convs", "n_children")} | {c: zero for c in ("node", "leaf", "saved")}
    marks = ranked.select("rank").unionByName(n_convs.select(F.col("n_convs").alias("rank"))).select("rank", F.lit(-1).cast("long").alias("depth"), *(v.alias(c) for c, v in empty.items()))
    placed = staged(running_sums(staged(weighed.unionByName(marks), "weighed"), ["rank", "depth"], ["node", "leaf", "saved"]), "placed")
    ends = placed.where(F.col("depth") < 0).select(F.col("rank").alias("stop"), F.col("before_node").alias("subtree_end"), F.col("before_leaf").alias("end_leaf"), F.col("before_saved").alias("end_saved"))
    out = placed.where(F.col("depth") >= 0).withColumn("stop", F.col("rank") + F.col("n_convs")).join(ends, "stop")

    sizes = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("depth"))
    stops = _ends(ranked).join(ranked.select("rank", "conv_id"), "rank").join(sizes, "conv_id", "left").select("rank", F.coalesce("depth", zero).alias("depth"), "ends_sha256")
    out = out.join(stops, ["rank", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end_leaf") - F.col("before_leaf")).alias("n_leaves"), (F.col("end_saved") - F.col("before_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.col("before_node").alias("preorder"), "subtree_end",
    )


#: The checksum of a number's decimal digits: the usual polynomial, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: "
    "list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295)"
)
ORACLE_SQL = f"""
WITH keyed AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS key, strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS place FROM keyed),
sizes AS (SELECT conv_id, count(*) AS long FROM turns GROUP BY 1),
convs AS (SELECT s.conv_id, s.conv_id - s.conv_id % 5 AS source, s.h, least(s.h, coalesce(b.long, 0)) AS n FROM (SELECT conv_id, {_CRC} % 9 AS h FROM sizes) s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5),
rebuilt AS (SELECT c.conv_id, place, key, n_bytes FROM convs c JOIN turns t ON t.conv_id = c.source AND place < h
    UNION ALL SELECT conv_id, place - h + n AS place, key, n_bytes FROM convs JOIN turns USING (conv_id) WHERE place >= h),
sequences AS (SELECT conv_id, coalesce(list(key ORDER BY place) FILTER (place IS NOT NULL), []) AS s, coalesce(list(n_bytes ORDER BY place) FILTER (place IS NOT NULL), []) AS b FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY 1),
members AS (SELECT conv_id, s, b, unnest(range(0, len(s) + 1)) AS depth FROM sequences),
nodes AS (SELECT depth, s[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(min(b[depth]), 0) AS n_bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256 FROM members GROUP BY ALL),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN children c ON c.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]),
over AS (SELECT path[1:d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1),
numbered AS (SELECT path, row_number() OVER (ORDER BY array_to_string(path, '')) - 1 AS preorder, count(*) OVER () AS n FROM nodes),
sized AS (SELECT path[1:d] AS path, count(*) AS below FROM (SELECT path, unnest(range(0, depth + 1)) AS d FROM nodes) GROUP BY 1)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256, preorder, (preorder + below)::BIGINT AS subtree_end
FROM full_nodes JOIN over USING (path) JOIN numbered USING (path) JOIN sized USING (path)
"""
