"""Null-safe, ANSI-safe scalar helpers shared by the operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------
NUMBER_TEXT = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
TIMESTAMP_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "MM-dd-yyyy"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
)
# -------------------------------------------------------------------------------------------


def as_col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def number(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Double value; NaN and unparsable text become null."""
    c = as_col(c)
    if isinstance(dtype, T.StringType):
        t = F.trim(c)
        return F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)) or dtype is None:
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    return c.cast("double")


def timestamp(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Timestamp of a temporal column or of text in one of the accepted forms, else null."""
    c = as_col(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    t = F.trim(c.cast("string"))
    return F.coalesce(
        *[F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in TIMESTAMP_FORMATS]
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null; every operator then only knows nulls.  Without fractional columns ``df`` itself comes back."""
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not fractional or getattr(df, "_assayer_nan_free", False):
        return df
    out = df.select(*[(F.when(~F.isnan(as_col(c)), as_col(c)) if c in fractional else as_col(c)).alias(c) for c in df.columns])
    out._assayer_nan_free = True  # operators call each other; the columns need it once
    out._assayer_settled = getattr(df, "_assayer_settled", False)
    return out


def nan_is_missing(operator: Callable) -> Callable:
    """An operator whose DataFrame arguments have their NaN read as null."""
    @functools.wraps(operator)
    def run(*args, **kwargs):
        read = lambda x: nan_to_null(x) if isinstance(x, DataFrame) else x
        return operator(*map(read, args), **{k: read(v) for k, v in kwargs.items()})

    return run


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over the rows that have both; null where one of them is constant, which ``corr`` may fail on."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.covar_pop(x, x) * F.covar_pop(y, y)))


def band(value: Column, cuts: Sequence[tuple[float, object]], default: object) -> Column:
    """First label whose lower bound the value reaches."""
    out = None
    for lo, label in cuts:
        out = F.when(value >= lo, F.lit(label)) if out is None else out.when(value >= lo, F.lit(label))
    return out.otherwise(F.lit(default))


def labels(*conditional: tuple[Column, str | Column]) -> Column:
    """Comma-joined labels whose condition holds, in the given order."""
    parts = [F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in conditional]
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def clip(c: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """Clamp that leaves null as null (``least``/``greatest`` would return the bound)."""
    out = F.when(c < lo, lo) if lo is not None else None
    if hi is not None:
        out = F.when(c > hi, hi) if out is None else out.when(c > hi, hi)
    return c if out is None else out.otherwise(c)


def unit_hash(cols: Iterable[str | Column], seed: int | str | Column) -> Column:
    """Uniform [0,1) value of a row key; the same on every engine, partitioning and retry."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", *[as_col(c).cast("string") for c in cols], seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def unit_hash64(cols: Iterable[str | Column], seed: int | str) -> Column:
    """Uniform (0,1) value of 52 bits of a row key, some ten times faster than ``unit_hash``, for draws that no SQL repeats.

    The same on every partitioning and retry, and with the same types of the key.
    """
    h = F.xxhash64(*[as_col(c) for c in cols], F.lit(str(seed)))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(2.0 ** 52)


def once(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A generator keeps the optimizer from copying an expensive expression into every place that refers to it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def title_case(c: Column) -> Column:
    """Capital after any non-letter, as opposed to ``initcap`` which only looks at blanks."""
    words = F.regexp_extract_all(c, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))),
        "",
    )


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def total(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
