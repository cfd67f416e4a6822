"""Folds over ordered series of any length: each row meets the state that the rows before it have left.

Rows of a key stream through one task in order, an Arrow batch at a time, and the state goes on from batch to batch; no
row ever holds a series. A long history can be cut at given points: each segment is a job of its own, whose states at the
end are written and handed on to the next, so that a lost executor costs a segment and not the whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sources.scratch import written


def fold(df: DataFrame, keys: list[str], order: list[str], out: str, start: Callable, step: Callable, cuts: list | None = None) -> DataFrame:
    """(keys, out) of what step() gives for the rows of each key, in the order of the columns ``order``.

    start() is a key's first state. step(state, row) gets the other columns of df as a tuple and gives the next state and
    a tuple of ``out`` or None. ``cuts``: values of the first column of the order before which a new segment begins.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(out).fields])
    if not cuts:
        return _segment(df, keys, order, schema, start, step, None).where("_state is null").drop("_state")
    first, done, states = F.col(order[0]), None, None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        own = df if lo is None else df.where(first >= F.lit(lo))
        own = own if hi is None else own.where(first < F.lit(hi))
        made = written(_segment(own, keys, order, schema, start, step, states), "fold")
        states = made.where("_state is not null").select(*keys, "_state")
        rows = made.where("_state is null").drop("_state")
        done = rows if done is None else done.unionByName(rows)
    return done


def _segment(df, keys, order, schema, start, step, states):
    """The rows that step() gives, and one with the state of each key after its last row."""
    names = [c for c in df.columns if c not in keys]
    own = df.select(*keys, *names).withColumn("_state", F.lit(None).cast("binary"))
    if states is not None:
        own = own.unionByName(states, allowMissingColumns=True)
    ddl = T.StructType([*schema.fields, T.StructField("_state", T.BinaryType())])
    k, places = len(keys), {f.name: i for i, f in enumerate(schema.fields)}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(ddl)
        key = state = None
        held = []

        def flush():
            columns = zip(*held) if held else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None or row[:k] != key:
                    if key is not None:
                        held.append((*key, *[None] * (len(places) - k), pickle.dumps(state)))
                    key, state = row[:k], start()
                if row[-1] is not None:
                    state = pickle.loads(row[-1])  # noqa: S301  made by this function
                    continue
                state, given = step(state, row[k:-1])
                if given is not None:
                    held.append((*key, *given, None))
                if len(held) >= 4096:
                    yield flush()
                    held = []
        if key is not None:
            held.append((*key, *[None] * (len(places) - k), pickle.dumps(state)))
        yield flush()

    return own.repartition(*keys).sortWithinPartitions(*keys, F.col("_state").isNull(), *order).mapInArrow(run, ddl)
