"""Functions of users' own: vectorised scalars by name, and aggregates that are folded in parts.

A scalar gets whole Arrow batches as pandas series. An aggregate is given by what a state is at first, how a batch of a group's
values is folded into it, how two states are merged, and what comes of it at last. Each task folds its rows by group before anything is shuffled, so that a group that
holds a third of all rows comes as one state a task; the states of a group are merged in one place, in an order of their own.

Edge cases: null values are left out unless ``nulls`` is set; null groups are one group; a group without values gets what comes of a first state; an
empty table has no groups; states must be picklable and stay small.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import check_unique, col, find

#: Groups whose states a task holds before it hands them on.
HELD = 50_000


def scalar(fn: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of columns that runs ``fn`` on whole batches of them."""
    return F.pandas_udf(fn, returns)


def register_scalar(spark: SparkSession, name: str, fn: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """The same under a name that SQL expressions can call; names of built-in functions are refused."""
    if not name.isidentifier():
        raise OpError("invalid_argument", f"{name!r} is no name of a function")
    if spark.sql(f"SHOW SYSTEM FUNCTIONS LIKE '{name.lower()}'").count():
        raise OpError("duplicate_function", f"there is a function {name} already")
    own = scalar(fn, returns)
    spark.udf.register(name, own)
    return own


@dataclass(frozen=True)
class Aggregate:
    """A user's aggregate: ``first()`` state, ``fold(state, values)``, ``merge(state, state)``, ``last(state)`` of the SQL type ``returns``."""

    first: Callable[[], object]
    fold: Callable[[object, pd.Series], object]
    merge: Callable[[object, object], object]
    last: Callable[[object], object]
    returns: str
    nulls: bool = False


def aggregate(df: DataFrame, by: Sequence[str], column: str, fn: Aggregate, as_: str, held: int = HELD) -> DataFrame:
    """(by…, as_) of each group; rows are folded where they are, and states are shuffled."""
    keys, value = [find(df.columns, b) for b in by], find(df.columns, column)
    check_unique([*keys, as_])
    group = F.to_json(F.array(*(col(k).cast("string") for k in keys)), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = df.select(group.alias("g"), F.struct(*(col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.lit(0).alias("one")).alias("k"), col(value).alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, list] = {}

        def handed_on() -> pa.RecordBatch:
            names, keys_, blobs = list(states), [s[0] for s in states.values()], [pickle.dumps(s[1]) for s in states.values()]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys_, kind), pa.array(blobs, pa.binary())], names=["g", "k", "state"])
            states.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("k").type
            values, groups = batch.column(2).to_pandas(), pd.Series(batch.column(0).to_pylist(), dtype=object)
            for name, at in groups.groupby(groups, sort=False).indices.items():
                held_ = states.setdefault(name, [batch.column(1)[int(at[0])].as_py(), fn.first()])
                own = values.iloc[at]
                own = own if fn.nulls else own.dropna()
                if len(own):
                    held_[1] = fn.fold(held_[1], own)
            if len(states) >= held:
                yield handed_on()
        if states:
            yield handed_on()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, key, state = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([fn.last(state)], to_arrow)], names=["k", "out"])

        for batch in batches:
            kind = batch.schema.field("k").type
            for i in range(batch.num_rows):
                own, got = batch.column(0)[i].as_py(), pickle.loads(batch.column(2)[i].as_py())  # noqa: S301 - states of this job's own tasks
                if own == name:
                    state = fn.merge(state, got)
                    continue
                if name is not None:
                    yield done()
                name, key, state = own, batch.column(1)[i].as_py(), got
        if name is not None:
            yield done()

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(df.sparkSession.sql(f"SELECT CAST(NULL AS {fn.returns}) AS x").schema["x"].dataType)
    kinds = f"struct<{', '.join([*(f'k{i}: {df.schema[k].dataType.simpleString()}' for i, k in enumerate(keys)), 'one: int'])}>"
    parts = rows.mapInArrow(partial, f"g string, k {kinds}, state binary")
    # States come in the order of their bytes, so that a merge that isn't quite symmetric gives one result always.
    dealt = parts.repartition("g").sortWithinPartitions("g", "state") if keys else parts.coalesce(1).sortWithinPartitions("g", "state")
    out = dealt.mapInArrow(final, f"k {kinds}, out {fn.returns}")
    return out.select(*(F.col("k").getField(f"k{i}").alias(k) for i, k in enumerate(keys)), F.col("out").alias(as_))
