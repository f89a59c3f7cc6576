"""Column expressions: header fields, digests, blocks, times, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lookup(table: dict[str, object], key: Column) -> Column:
    """The key's value in a constant table of strings or numbers; null where it has none."""

    def lit(x: object) -> str:
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return F.try_element_at(F.expr("map(" + ",".join(f"{lit(k)},{lit(v)}" for k, v in table.items()) + ")"), key)
