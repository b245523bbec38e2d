"""Finding and quoting columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.errors import OpError


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def find(columns: list[str], name: str) -> str:
    """The column meant by ``name``: itself in any case, else the one column that ends in ``.name`` or ``__name``."""
    wanted = str(name).casefold()
    base = wanted.rpartition(".")[2]
    for test in (
        lambda c: c == name,
        lambda c: c.casefold() == wanted,
        lambda c: c.casefold() == base,
        lambda c: c.casefold().endswith("__" + base),
        lambda c: c.casefold().endswith("." + base),
    ):
        if len(found := [c for c in columns if test(c)]) == 1:
            return found[0]
    raise OpError("unknown_column", f"no column {name!r}", available_columns=list(columns))


def check_unique(names: list[str]) -> None:
    """Spark tells names apart by more than case only, so uniqueness is checked before it sees them."""
    low = [n.casefold() for n in names]
    if twice := sorted({n for n in names if low.count(n.casefold()) > 1}):
        raise OpError("duplicate_column", f"columns are named twice: {twice}")
