"""Small column helpers shared by every plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column, default: float | None = None) -> Column:
    """num / den, or ``default`` where den is 0 or NULL."""
    n, d = col(num).cast("double"), col(den).cast("double")
    out = F.when(d != 0, n / d)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def pct_change(cur: str | Column, base: str | Column) -> Column:
    b = col(base)
    return safe_div(col(cur) - b, b) * 100


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Clamp; NULL stays NULL (greatest and least would skip it)."""
    v = col(c)
    return F.when(v.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))


def flag(cond: Column) -> Column:
    """Boolean to 0/1; NULL counts as 0 (flags are averaged)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def bucket_label(value: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """First label whose edge exceeds the value; the last label takes the rest."""
    v = col(value)
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(v < edge, F.lit(label)).otherwise(out)
    return out


def cut_label(value: str | Column, bins: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals ``(lo, hi]``; values outside every bin give NULL."""
    v = col(value)
    whens = [(v > lo) & (v <= hi) for lo, hi in zip(bins, bins[1:])]
    return F.coalesce(*[F.when(w, F.lit(label)) for w, label in zip(whens, labels)])


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def round_at(x: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic, so other engines agree bit for bit."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def round_half_even(x: str | Column) -> Column:
    """Nearest integer, ties to even, as a double."""
    return F.bround(col(x), 0)


def attach_row(df, one_row):
    """Add the columns of a one-row aggregate to every row, as a scalar
    subquery: a single literal row, never a join."""
    row = one_row.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def repeat_for(df, names: Sequence[str], rows: Sequence[tuple]):
    """Repeat every row for each tuple of a fixed parameter list."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return df.withColumn("_p", F.explode(F.array(*structs))).select(*df.columns, "_p.*")


def literal_rows(spark, schema: str, rows: Sequence[tuple]):
    """A small parameter table (rule ids, thresholds, offsets)."""
    return spark.createDataFrame(list(rows), schema)
