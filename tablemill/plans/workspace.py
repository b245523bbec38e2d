"""A workspace of named tables: each call checks its arguments, adds one immutable handle, and runs nothing.

Handles hold lazy DataFrames, so Spark plans whole chains of calls at once. A call that is
rejected changes nothing. Every handle keeps facts on how it was made; ``lineage`` gives them
as a DataFrame, and ``restore`` goes back to an earlier set of handles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError, feedback_of
from tablemill.operators import compare, groups, joins, ordering, perception, rows, scalars, search, sets
from tablemill.plans import sql as sql_

#: Legal calls: tool name to the method that serves it and the kind its handles are named by.
TOOLS = {
    "condition_filter": "filter", "filter_rows": "filter", "project": "project", "project_typed": "project", "shape_rows": "project", "derive_column": "derive",
    "distinct": "distinct", "group_aggregate": "group", "aggregate_typed": "group", "pivot": "pivot", "join_tables": "join", "join_typed": "join", "set_op": "setop",
    "set_operation": "setop", "window": "window", "add_rank": "rank", "rank_select": "rank", "sort": "sort", "limit": "limit", "extreme_value_select": "top",
    "scalar_compute": "scalar", "scalar_compute_typed": "scalar", "execute_sql": "sql",
}
#: What an operator does to the order of its input.
KEEPS_ORDER, MAKES_ORDER = {"filter", "project", "derive"}, {"sort", "limit", "top"}
MOST_CHECKPOINTS = 8


@dataclass(frozen=True)
class Handle:
    name: str
    df: DataFrame
    kind: str
    inputs: tuple[str, ...] = ()
    facts: Mapping = field(default_factory=dict)
    ordered: bool = False

    @property
    def columns(self) -> list[str]:
        return self.df.columns


class Workspace:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark = spark
        self.handles: dict[str, Handle] = {n: Handle(n, df, "source") for n, df in tables.items()}
        self.made = 0
        self.saved: dict[str, dict[str, Handle]] = {}

    # -- names -------------------------------------------------------------------------
    def handle(self, name) -> Handle:
        if isinstance(name, Mapping) and set(name) == {"table"}:
            name = name["table"]
        found = self.handles.get(name) or next((h for n, h in self.handles.items() if n.casefold() == str(name).casefold()), None)
        if not found:
            raise OpError("unknown_table", f"no table {name!r}", available_tables=list(self.handles))
        return found

    def table(self, name) -> DataFrame:
        """The rows of a handle, or of one column of it named ``handle.column``."""
        if isinstance(name, DataFrame):
            return name
        if isinstance(name, str) and name not in self.handles and "." in name:
            owner, _, column = name.rpartition(".")
            return rows.shape_rows(self.table(owner), [{"column": column}])
        return self.handle(name).df

    # -- calls -------------------------------------------------------------------------
    def _build(self, tool: str, args: dict) -> tuple[DataFrame, list]:
        """The result of a call and the tables it reads."""
        own = dict(args)
        if tool == "join_tables" and "joins" in own:
            chain = [{**j, "name": self.handle(j["table"]).name, "table": self.table(j["table"])} for j in own["joins"]]
            base = self.handle(own["base"])
            return joins.join_tables((base.name, base.df), chain, own.get("base_role")), [own["base"], *(j["table"] for j in own["joins"])]
        if tool == "join_tables":
            return joins.join_prefixed([self.table(t) for t in own["tables"]], own["on"], own.get("join_types"), own.get("prefixes")), own["tables"]
        if tool in ("set_op", "set_operation", "join_typed"):
            left, right = own.pop("left"), own.pop("right")
            run = {"set_op": sets.set_op, "set_operation": sets.set_operation, "join_typed": lambda a, b, **k: joins.join_pair(a, b, ops=True, **k)}[tool]
            return run(self.table(left), self.table(right), **own), [left, right]
        if tool == "scalar_compute":
            used = [o["value_ref"] for o in own["operands"] if isinstance(o, Mapping)]
            operands = [self.table(o["value_ref"]) if isinstance(o, Mapping) else o for o in own["operands"]]
            return scalars.scalar_compute(self.spark, own["operation"], operands, own.get("result_name", "value")), used
        if tool == "execute_sql":
            return sql_.execute_sql(self.spark, own["sql"], {n: h.df for n, h in self.handles.items()}), sql_.inputs_of(own["sql"], self.handles)
        name = own.pop("table")
        df = self.table(name)
        if tool in ("condition_filter", "group_aggregate"):
            own["tables"] = self.table
        if "as" in own:
            own["as_"] = own.pop("as")
        home = next(m for m in (rows, groups, ordering, scalars) if hasattr(m, tool))
        return getattr(home, tool)(df, **own), [name]

    def call(self, tool: str, **args) -> Handle:
        """Adds the handle of one call; a rejected call raises and adds nothing."""
        if tool not in TOOLS:
            raise OpError("unknown_tool", f"no tool {tool!r}", available_tools=sorted(TOOLS))
        try:
            df, used = self._build(tool, args)
        except (KeyError, TypeError) as error:
            raise OpError("invalid_arguments", f"{tool}: {error}") from error
        named = (u["table"] if isinstance(u, Mapping) else u for u in used)
        inputs = tuple(self.handle(u if u in self.handles else u.rpartition(".")[0] or u).name for u in named if isinstance(u, str))
        kind = TOOLS[tool]
        ordered = kind in MAKES_ORDER or kind in KEEPS_ORDER and bool(inputs) and self.handles[inputs[0]].ordered and not args.get("distinct")
        self.made += 1
        made = Handle(f"{kind}_{self.made:03d}", df, kind, inputs, {k: v for k, v in args.items() if k not in ("table", "left", "right", "base")}, ordered)
        self.handles[made.name] = made
        return made

    def check(self, tool: str, **args) -> list[str]:
        """The columns that a call would give; nothing is added."""
        return self._build(tool, args)[0].columns

    def try_call(self, tool: str, **args) -> Handle | dict:
        """A handle, or structured feedback on why there is none."""
        try:
            return self.call(tool, **args)
        except Exception as error:
            return feedback_of(error)

    def run(self, steps: list[Mapping], isolate: bool = False) -> dict[str, Handle | dict]:
        """Steps ``{"id", "tool", "args"}`` in order; an ``{"step": id}`` anywhere in args is that step's table.

        With ``isolate`` a rejected step gives feedback, and only steps that use it are left out.
        """
        done: dict[str, Handle | dict] = {}

        def filled(value):
            if isinstance(value, Mapping) and set(value) == {"step"}:
                if value["step"] not in done:
                    raise OpError("unknown_step", f"no step {value['step']!r} before this one")
                if isinstance(done[value["step"]], dict):
                    raise OpError("blocked", f"step {value['step']!r} failed")
                return done[value["step"]].name
            if isinstance(value, Mapping):
                return {k: filled(v) for k, v in value.items()}
            return [filled(v) for v in value] if isinstance(value, list) else value

        for step in steps:
            if step["id"] in done:
                raise OpError("duplicate_step", f"two steps are called {step['id']!r}")
            try:
                done[step["id"]] = self.call(step["tool"], **filled(step.get("args", {})))
            except Exception as error:
                if not isolate:
                    raise
                done[step["id"]] = feedback_of(error)
        return done

    # -- state -------------------------------------------------------------------------
    def checkpoint(self, name: str) -> None:
        if name not in self.saved and len(self.saved) >= MOST_CHECKPOINTS:
            raise OpError("too_many_checkpoints", f"{MOST_CHECKPOINTS} at most")
        self.saved[name] = dict(self.handles)

    def restore(self, name: str) -> None:
        """The handles of a checkpoint; numbers of handles made since aren't used again."""
        if name not in self.saved:
            raise OpError("unknown_checkpoint", f"no checkpoint {name!r}")
        self.handles = dict(self.saved[name])

    def lineage(self) -> DataFrame:
        """(handle, kind, input): one row for each table that a handle is made from."""
        out = [(h.name, h.kind, i) for h in self.handles.values() for i in h.inputs or ([None] if h.kind != "source" else [])]
        return self.spark.createDataFrame(out, "handle string, kind string, input string")

    def backward_slice(self, name: str) -> list[str]:
        """The handles that ``name`` depends on, sources first."""
        seen: list[str] = []

        def visit(n: str) -> None:
            for i in self.handle(n).inputs:
                visit(i)
            if n not in seen:
                seen.append(n)

        visit(self.handle(name).name)
        return seen

    def replay(self, name: str, tables: Mapping[str, DataFrame], steps: list[Mapping]) -> Handle:
        """The step ``name`` of a recorded program over other tables."""
        out = Workspace(self.spark, tables).run(steps)[name]
        return out

    def provenance(self) -> DataFrame:
        """(handle, input, column): the columns that each call names of its inputs, by what its arguments say."""
        out = []
        for h in self.handles.values():
            for i in h.inputs:
                known = {c.casefold(): c for c in self.handles[i].columns} if i in self.handles else {}
                words = " ".join(map(str, _leaves(h.facts))).casefold()
                out += [(h.name, i, c) for low, c in known.items() if re.search(rf"(?<![\w.]){re.escape(low)}(?![\w.])", words)]
        return self.spark.createDataFrame(out, "handle string, input string, column string")

    def answer(self, name: str) -> DataFrame:
        """The table of a handle, as it is."""
        return self.handle(name).df


def _leaves(value) -> list:
    """All values in nested arguments."""
    if isinstance(value, Mapping):
        return [x for v in value.values() for x in _leaves(v)]
    return [x for v in value for x in _leaves(v)] if isinstance(value, (list, tuple)) else [value]


def equivalent(spark: SparkSession, first: list[Mapping], second: list[Mapping], answer: str, databases: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """(database, equal, has_rows): whether two programs answer alike on each of some databases.

    Databases without rows in the answer say little, so whether there are any is told.
    """
    out = None
    for name, tables in databases.items():
        a, b = (Workspace(spark, tables).run(steps)[answer].df for steps in (first, second))
        some = a.limit(1).agg((F.count("*") > 0).alias("has_rows"))
        row = compare.same_set(a, b).crossJoin(some).select(F.lit(name).alias("database"), "equal", "has_rows")
        out = row if out is None else out.unionByName(row)
    return out


def _reader(method: Callable) -> Callable:
    def run(self: Workspace, table, *args, **kwargs):
        return method(self.table(table), *args, **kwargs)

    run.__doc__ = method.__doc__
    return run


for _tool in TOOLS:
    setattr(Workspace, _tool, lambda self, *a, _t=_tool, **k: self.call(_t, **(dict(zip(("table",), a, strict=False)) | k)))
for _name in ("inspect_column", "column_summary", "value_counts", "sample_values", "count_nulls", "read_subtable", "read_rows", "preview", "page"):
    setattr(Workspace, _name, _reader(getattr(perception, _name)))
for _name in ("search_values", "search_values_bounded"):
    setattr(Workspace, _name, _reader(getattr(search, _name)))
