"""Query registry: a Spark plan, its independent SQL, and the output columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.catalog.shapes_sql import expand
from tidebook.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK_TYPES = {"i": "int", "l": "bigint", "s": "string", "d": "date", "t": "timestamp_ntz"}
_SQL_TYPES = {"i": "integer", "l": "bigint", "s": "varchar", "d": "date", "t": "timestamp"}


def _parse(out: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) for p in out.split()]


def _spark_cols(out: str):
    for name, t in _parse(out):
        c = F.col(name)
        if t.isdigit():
            # Same IEEE operations on both sides, so ties cannot round differently.
            scale = 10.0 ** int(t)
            yield (F.floor(c.cast("double") * scale + 0.5) / scale).alias(name)
        else:
            yield c.cast(_SPARK_TYPES[t]).alias(name)


def _sql_cols(out: str):
    for name, t in _parse(out):
        if t.isdigit():
            scale = f"{10 ** int(t)}.0::double"
            yield f"floor(cast({name} as double) * {scale} + 0.5) / {scale} as {name}"
        else:
            yield f"cast({name} as {_SQL_TYPES[t]}) as {name}"


def query(name: str, out: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``.

    ``out`` lists ``column:type`` with type i, l, s, d, t, or a digit count for
    a double rounded to that many digits; both sides are projected onto it.
    """

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir)).select(*_spark_cols(out))

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"select {', '.join(_sql_cols(out))} from ({expand(sql)}) _q"
        return fn

    return deco
