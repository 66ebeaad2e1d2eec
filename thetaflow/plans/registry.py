"""Registry of named queries: a Spark builder plus the equivalent DuckDB SQL.

Builders return unrounded values; ``Query.build`` is what a caller uses.  The
registered form (``Query.spark``), which is compared side by side with SQL,
rounds double columns on both sides to ``DIGITS`` significant digits, whatever
their magnitude: both engines round the exact binary value.  Columns that come
out of a cancellation, where the engines' different orders of summation leave
noise near zero, are rounded to a number of decimals instead; ``decimals``
names them with that number (``*``: all doubles that it doesn't name).  ``exact`` names the columns that are compared as
they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, "Query"] = {}


#: Significant digits of compared doubles.
DIGITS = 10


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    exact: tuple[str, ...] = field(default_factory=tuple)
    decimals: dict[str, int] = field(default_factory=dict)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.build(spark, sf_dir), self.decimals)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return rounded_sql(self.sql, self.exact, self.decimals)


DEFAULT_EXACT = ("securityid", "date", "expiration")


def register(name: str, sql: str | None = None, exact=DEFAULT_EXACT, decimals: dict[str, int] | None = None):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, tuple(exact), decimals or {})
        return fn
    return deco


def rounded(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Round doubles like C's ``printf`` (the SQL side): the exact binary
    value, ties to even, as ``format_number`` does (``format_string`` would
    round the shortest decimal form half-up).

    A value that equals a whole number of ten-thousandths below 1e6 has ten digits and four decimals at most, so it is
    its own rounded form and is not formatted.  ``+ 0.0`` makes a zero positive."""
    scientific = "0." + "0" * (DIGITS - 1) + "E0"
    cols = []
    for f in df.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            form = decimals.get(f.name, decimals.get("*", f"'{scientific}'"))
            # the lambda keeps Spark from compiling all columns' formatting into one method, too long for the JVM's compiler
            text = f"transform(array({name}), v -> CAST(replace(format_number(v, {form}), ',', '') AS DOUBLE) + 0.0D)[0]"
            short = f"WHEN abs({name}) < 1e6D AND rint({name} * 1e4D) / 1e4D = {name} THEN {name} + 0.0D" if form == f"'{scientific}'" else ""
            cols.append(F.expr(f"CASE {short} WHEN abs({name}) < double('inf') THEN {text} ELSE {name} END").alias(f.name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def rounded_sql(sql: str, exact, decimals: dict[str, int]) -> str:
    """Wrap ``sql`` so every column not in ``exact`` is rounded like above."""
    def names(x):
        return ", ".join("'" + n.replace("'", "''") + "'" for n in x) or "''"

    def some(condition: str, form: str) -> str:
        return (f"CAST(list_transform([COLUMNS(lambda c: {condition})], lambda v: printf('{form}', v))[1] AS DOUBLE) "
                "+ CAST(0.0 AS DOUBLE)")

    parts = [f"COLUMNS(lambda c: c IN ({names(exact)}))"] if exact else []
    parts += [some(f"c IN ({names([n])})", f"%.{d}f") for n, d in decimals.items() if n != "*"]
    rest = f"%.{decimals['*']}f" if "*" in decimals else f"%.{DIGITS - 1}e"
    return ("SELECT " + ", ".join([*parts, some(f"c NOT IN ({names([*exact, *decimals])})", rest)])
            + f"\nFROM (\n{sql}\n) AS q")
