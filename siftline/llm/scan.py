"""Running values along sorted groups, where a group may lie in many partitions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from siftline.llm.common import stored

State = tuple[int, ...]


def scanned(rows: DataFrame, group: str, order: tuple[str, ...], reads: tuple[str, ...], fields: str, start: State, step: Callable[[State, tuple], State], join: Callable[[State, State], State]) -> DataFrame:
    """rows with the state after each row of its group, in the given order (ascending, null first).

    Rows are dealt out by ranges of (group, order), so a group with a third of all rows is split like any other stretch of rows. Each partition is
    folded as a stream; the state in which it ends, one row a partition, goes to the driver, and rows of a group that began in an
    earlier partition get what was carried: join(state before, state within). step(state, values of `reads`) is the fold itself.
    """
    shape = rows.sparkSession.createDataFrame([], fields).schema
    names = shape.names
    out = StructType([*rows.schema.fields, *shape.fields, StructField("__part", IntegerType()), StructField("__head", BooleanType()), StructField("__last", BooleanType())])

    def run(batches):
        part, now, state, head, held = TaskContext.get().partitionId(), None, start, True, None
        begun = False

        def made(batch, states, heads, last):
            columns = [pa.array(x, pa.int64()) for x in zip(*states)]
            lasts = [False] * len(states)
            lasts[-1] = last
            return pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([part] * len(states), pa.int32()), pa.array(heads), pa.array(lasts)], out.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            states, heads = [], []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in (group, *reads))):
                if not begun or key != now:
                    head, begun, now, state = not begun, True, key, start
                state = step(state, values)
                states.append(state)
                heads.append(head)
            if held:
                yield made(*held, False)
            held = (batch, states, heads)
        if held:
            yield made(*held, True)

    table = stored(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(run, out), "scan")
    carried, before = {}, None
    for r in sorted(table.filter("__last").select("__part", "__head", F.col(group).alias("g"), F.struct(*names).alias("s")).collect(), key=lambda r: r["__part"]):
        if before:
            carried[r["__part"]] = before
        state = tuple(r.s)
        before = (r.g, join(before[1], state) if before and r["__head"] and before[0] == r.g else state)
    kept = [*rows.columns, *names]
    if not carried:
        return table.select(kept)

    def mend(batches):
        for batch in batches:
            given = batch.to_pydict()
            for i, (key, part) in enumerate(zip(given[group], given["__part"])):
                if part in carried and carried[part][0] == key:
                    for name, x in zip(names, join(carried[part][1], tuple(given[n][i] for n in names))):
                        given[name][i] = x
            columns = [pa.array(given[n], pa.int64()) if n in names else batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays(columns, kept)

    mended = table.filter("__head").select(*kept, "__part").mapInArrow(mend, StructType(out.fields[: len(kept)]))
    return table.filter("NOT __head").select(kept).unionByName(mended)
