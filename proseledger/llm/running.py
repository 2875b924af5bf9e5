"""Running sums over a whole table in order: every range of the order is summed where it lies, then shifted by what comes before it.

No window over the whole table and none over a group, so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged


def running_sums(rows: DataFrame, order: list[str], sums: list[str], group: str | None = None) -> DataFrame:
    """``rows`` with ``before_<name>`` for each of the long columns in ``sums``: what the rows before it in ``order`` add up to.

    With ``group``, a long column that ``order`` starts with, the sums start anew in each group. Rows that are equal in
    all of ``order`` may be split over tasks only if ``order`` tells them apart, so add a column that does where many can be equal.
    The result is a written table; of it one row for each task and each group that lies in several tasks is joined back.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    before = [f"before_{c}" for c in sums]
    schema = f"{kinds}, _part int, " + ", ".join(f"{c} long" for c in before)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried, last = TaskContext.get().partitionId(), np.zeros(len(sums), np.int64), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.arange(n)
            own = np.zeros(n, np.int64) if group is None else batch.column(group).to_numpy(zero_copy_only=False)
            fresh = np.r_[last is None or own[0] != last, own[1:] != own[:-1]]
            if fresh[0]:
                carried[:] = 0
            began = np.maximum.accumulate(np.where(fresh, at, 0))
            first = began == 0
            found = []
            for k, name in enumerate(sums):
                weights = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(weights)
                inside = upto - weights
                found.append(inside - inside[began] + np.where(first, carried[k], 0))
                carried[k] = found[-1][-1] + weights[-1]
            last = own[-1]
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", *before])

    summed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema), "running")
    keys = ["_part"] if group is None else [group, "_part"]
    totals = summed.groupBy(*keys).agg(*(F.sum(c).alias(f"_all_{c}") for c in sums))
    if group is None:
        earlier = Window.orderBy("_part")  # one row for each task
    else:
        spread = totals.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        totals = totals.join(spread.select(group), group, "left_semi")  # at most two rows for each task
        earlier = Window.partitionBy(group).orderBy("_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, *(F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_shift_{c}") for c in sums))
    out = summed.join(F.broadcast(shifts), keys, "left")
    moved = {b: F.col(b) + F.coalesce(F.col(f"_shift_{c}"), F.lit(0)) for b, c in zip(before, sums, strict=True)}
    return out.withColumns(moved).select(*rows.columns, *before)
