"""Queries of one operator over awkward inputs, with results worked out by hand.

The tables hold no Markdown, paths, status lines or records of the kinds that many
operators are for.  So their inputs are dealt out to ``documents``, one for each row by
its id, and the SQL twin deals out the results that the rules ask for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import register

_SQL_TYPES = {"string": "varchar", "boolean": "boolean", "bigint": "bigint", "double": "double"}


def sql_literal(value) -> str:
    """A DuckDB literal; texts may hold any character but NUL."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def dealt(values: list, id_col: str = "doc_id") -> Column:
    """One of ``values`` for each row, by its id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(id_col), F.lit(len(values))) + 1).cast("int"))


def dealt_sql(values: list, kind: str, id_col: str = "doc_id") -> str:
    return f"cast([{', '.join(map(sql_literal, values))}] as {_SQL_TYPES[kind]}[])[{id_col} % {len(values)} + 1]"


def cases(name: str, rows: list[tuple], kind: str = "string"):
    """Registers an operator (a function of columns) over ``rows`` of arguments and, last, the result."""
    inputs = list(zip(*(r[:-1] for r in rows)))
    wanted = [r[-1] for r in rows]

    def add(operator: Callable[..., Column]):
        def query(spark, sf_dir):
            arguments = [dealt(list(v)).alias(f"x{k}") for k, v in enumerate(inputs)]
            picked = table(spark, sf_dir, "documents").select("doc_id", *arguments)
            return picked.select("doc_id", operator(*(F.col(f"x{k}") for k in range(len(inputs)))).cast(kind).alias("result"))

        query.__name__ = name
        register(name, f"select doc_id, {dealt_sql(wanted, kind)} result from documents")(query)
        return operator

    return add
