"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Tokens are those of a plain tokenizer, runs of letters and digits and single marks, counted by a regular expression; the
counts of another tokenizer can be given as a column instead.

Groups (equal texts) are placed as wholes, each where the dot product of its vector with the shards' residual
capacities is highest, the largest groups first. Groups of more than a 64th of a shard in some resource, of which there are
at most 64 for each shard and resource, are packed on the driver; one that exceeds a whole shard is cut into pieces by a hash
of its rows, since it can't fit. All others are dealt by hash into blocks of about ``block_groups`` groups. Each block is
packed in a task of its own, into as large a part of what is left of every shard as it is of all that is left, so
every group is placed by the same rule, whatever the size of the input, and none is bundled with others.

Cases: a null text has no bytes (and counts as the empty text); rows with equal ids and texts are numbered apart; an
empty table gives an empty one; null ids are placed like others; further columns are not carried; of equal products the first
shard is taken, of equally large groups that with the smaller hash comes first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, text_of

_RESOURCES = ("size", "tokens", "rows")
_GROUP = ["_h1", "_h2"]
_LARGE = 1 / 64
#: A run of letters and digits (of ASCII, or anything beyond it), or one mark.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
WEIGHTS = (1.0, 0.2, 0.2)


def pack(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS, left: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item (a row of its resources). Of equal products the first shard is taken.

    ``total`` is what shares are of, the sum of the items if not given; ``left`` the residual capacities as weighted shares, equal ones
    if not given, from which the items are taken.
    """
    share = items / np.maximum(items.sum(0) if total is None else total, 1) * np.array(weights)
    if left is None:
        left = np.tile(share.sum(0) / shards, (shards, 1))
    where = np.zeros(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -share.max(1))):
        where[i] = best = np.argmax(left @ share[i])
        left[best] -= share[i]
    return where


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tokens: Column | None = None, block_groups: int = 20_000) -> DataFrame:
    """One row for each row of ``docs``: id, size (UTF-8 bytes and ``overhead``), text_crc32, law ("bytes"), shard, slot (gapless in the shard), grown_shard (null).

    The texts are read once and never shuffled; what is shuffled are sizes and hashes.
    """
    spark, text = docs.sparkSession, text_of(text_col)
    rows = docs.select(
        docs[id_col].alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.coalesce(F.regexp_count(text, F.lit(TOKEN)) if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_h1"),
        F.xxhash64(F.lit("second"), text).alias("_h2"),
    )
    rows = staged(rows, "shard-rows")
    sums = [F.sum(r).alias(r) for r in _RESOURCES]
    groups = staged(rows.groupBy(*_GROUP).agg(*sums), "shard-groups")
    totals = groups.agg(F.count("*").alias("groups"), *(F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in _RESOURCES)).first()
    total = np.array([totals[r] for r in _RESOURCES], float)
    # of what a shard holds, the part that a group takes in the resource that it needs most
    part = F.greatest(*(F.col(r) * shards / F.lit(max(totals[r], 1)) for r in _RESOURCES))
    large = groups.withColumn("_pieces", F.when(part > 1, F.ceil(part * 4)).otherwise(1).cast("int")).where(part > _LARGE)
    keys = large.select(*_GROUP, "_pieces").collect()
    keys = F.broadcast(spark.createDataFrame(keys, "_h1 long, _h2 long, _pieces int"))
    of_large = rows.join(keys, _GROUP).withColumn("_piece", F.pmod(F.xxhash64("_id", "_row"), F.col("_pieces")).cast("int")).drop("_pieces")
    # as many rows as there are large groups and their pieces; what all pieces exceed together is bounded by the shards
    items = of_large.groupBy(*_GROUP, "_piece").agg(*sums).orderBy(*_GROUP, "_piece").toPandas()
    left = np.tile(np.array(WEIGHTS) * (total > 0) / shards, (shards, 1))
    where = pack(items[[*_RESOURCES]].to_numpy(float).reshape(-1, 3), shards, left=left, total=total)
    placed = [(int(a), int(b), int(c), int(s)) for a, b, c, s in zip(*(items[k] for k in (*_GROUP, "_piece")), where, strict=True)]
    placed = F.broadcast(spark.createDataFrame(placed, "_h1 long, _h2 long, _piece int, shard int"))

    def place(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(_GROUP)
        own = block[[*_RESOURCES]].to_numpy(float)
        room = left / np.where(left.sum(0) > 0, left.sum(0), 1) * (own.sum(0) / np.maximum(total, 1) * np.array(WEIGHTS))
        return block[_GROUP].assign(shard=pack(own, shards, left=room, total=total))

    blocks = max(1, -(-totals["groups"] // block_groups))
    small = groups.where(part <= _LARGE).withColumn("_block", F.pmod("_h2", F.lit(blocks)))
    small = small.groupBy("_block").applyInPandas(place, "_h1 long, _h2 long, shard int")
    kept = ["_id", "_row", "size", "text_crc32", "shard"]
    out = of_large.join(placed, [*_GROUP, "_piece"]).select(*kept).unionByName(rows.join(small, _GROUP).select(*kept))
    # each shard is numbered in buckets, whose number grows with the input, so that no task numbers a whole shard
    buckets = max(8, -(-totals["rows"] // (shards * 50_000)))
    out = staged(out.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets))), "shard-placed")
    counts = out.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    starts = counts.select("shard", "_bucket", before.alias("_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_id", "text_crc32", "_row"))
    out = out.withColumn("_k", number - 1).join(starts, ["shard", "_bucket"])
    return out.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
