"""Arithmetic where a missing or undefined value is null, never NaN, infinity or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(a, b) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(c) -> Column:
    """Null for NaN and infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clamp(c, lo=None, hi=None) -> Column:
    """Into [lo, hi], null stays null; a bound may be open."""
    c = col(c)
    out = c if lo is None else F.greatest(c, F.lit(float(lo)))
    out = out if hi is None else F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def number(text) -> Column:
    """Text as a number, null where it is none."""
    return finite(F.expr(f"try_cast(`{text}` AS double)") if isinstance(text, str) else text.try_cast("double"))


def conform(df, schema):
    """df with exactly the columns of schema: missing ones null, others cast, in order."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
