"""Running totals within groups, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arrearly.llm.common import written

#: Totals are taken modulo 2**62, so that two of them can be added in 64 bits.
MASK = (1 << 62) - 1


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a group begins, the first row included."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def running_totals(
    df: DataFrame, group: list[str], order: list[str], totals: dict[str, str]
) -> DataFrame:
    """``df`` with, per entry ``{name: column}``, the total of the column over the rows of the
    same group up to and including this one, modulo 2**62.

    Group columns are numbers or booleans and not NULL; added columns are numbers from 0 to
    below 2**62. Every task sums up a range of the sorted rows and writes them; a group
    that reaches over several tasks gets what the tasks before had. For that the driver
    sees the first and the last row of every task, and nothing else.
    """
    keys = [*group, *order]
    extra = StructType.fromDDL(
        ", ".join([f"`{name}` long" for name in totals])
        + ", _task int, _lead boolean, _edge boolean"
    )
    schema = StructType([*df.schema.fields, *extra.fields])
    arrow = to_arrow_schema(schema)
    added = list(totals.values())

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last: tuple | None = None  # the group of the last row so far
        carry = np.zeros(len(added), dtype=np.uint64)
        lead, held = True, None
        for batch in it:
            if not batch.num_rows:
                continue
            at = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
            starts = _starts(at)
            here = tuple(c[0] for c in at)
            first = last is None
            lead = lead and (first or here == last)  # still in the first group of the task
            if here != last:
                carry[:] = 0
            sizes = np.diff(np.append(starts, batch.num_rows))
            sums = []
            for k, name in enumerate(added):
                x = batch.column(name).to_numpy(zero_copy_only=False).astype(np.uint64)
                total = np.cumsum(x, dtype=np.uint64)
                before = (total - x)[starts]
                before[0] -= carry[k]
                sums.append((total - np.repeat(before, sizes)) & np.uint64(MASK))
                carry[k] = sums[-1][-1]
            leads = np.zeros(batch.num_rows, dtype=bool)
            if lead:
                leads[: sizes[0]] = True
                lead = len(starts) == 1
            last = tuple(c[-1] for c in at)
            edge = np.zeros(batch.num_rows, dtype=bool)
            edge[0] = first
            made = [pa.array(x.astype(np.int64)) for x in sums]
            made += [pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(leads)]
            if held is not None:
                yield closed(*held)
            held = batch, made, edge
        if held is not None:
            held[2][-1] = True
            yield closed(*held)

    def closed(batch: pa.RecordBatch, made: list[pa.Array], edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(edge)], schema=arrow)

    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = written(ordered.mapInArrow(summed, schema))
    edges = (
        table.where("_edge").select("_task", *group, *totals, "_lead").orderBy("_task", *keys[: len(group)], *totals)
    ).collect()
    carries, last, total = [], None, [0] * len(totals)
    tasks: dict[int, list] = {}
    for e in edges:
        tasks.setdefault(e._task, []).append(e)
    for task, rows in sorted(tasks.items()):
        opening, closing = rows[0], rows[-1]
        if tuple(opening[c] for c in group) != last:
            total = [0] * len(totals)
        elif any(total):
            carries.append((task, *total))
        through = total if closing._lead else [0] * len(totals)
        total = [(closing[n] + t) & MASK for n, t in zip(totals, through)]
        last = tuple(closing[c] for c in group)
    # At most one row per task.
    brought = df.sparkSession.createDataFrame(
        carries, ", ".join(["_task int", *(f"`_{n}` long" for n in totals)])
    )
    whole = {
        n: F.when(F.col("_lead"), (F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).bitwiseAND(F.lit(MASK)))
        .otherwise(F.col(n))
        for n in totals
    }
    joined = table.join(F.broadcast(brought), "_task", "left").withColumns(whole)
    return joined.select(*df.columns, *totals)
