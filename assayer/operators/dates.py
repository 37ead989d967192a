"""Dates in text columns: formats are voted for by all values of a column, then every value is read by an accepted one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import as_col, nan_is_missing
from assayer.plans.columns import text_columns, unpivot_text

# Shape, format, and the format with day and month exchanged, in the order in which equal votes decide.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", None),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy", "M.d.yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy", None),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", None),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss", None),
)


def _read(value: Column, shape: str, pattern: str) -> Column:
    return F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)))


@nan_is_missing
def vote_formats(df: DataFrame, cols: Sequence[str] | None = None, day_first: bool = False) -> dict[str, tuple[int, list[tuple[str, str, int]]]]:
    """For each text column its number of values and (shape, format, votes) of the formats that read any, most votes first.

    One scan counts all formats in all columns.  Of a format and its exchange of day and month the one that reads more values
    stays, so a single value beyond twelve settles the whole column; ``day_first`` decides between equals.
    """
    cols = text_columns(df, cols)
    if not cols:
        return {}
    each = [(shape, p) for shape, one, other in FORMATS for p in (one, other) if p]
    value = F.trim("value")
    counted = unpivot_text(df, cols).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(_read(value, *f)).alias(f"f{i}") for i, f in enumerate(each)])
    out = {}
    for row in counted.collect():  # a row per column
        votes = {f: row[f"f{i}"] for i, f in enumerate(each)}
        kept = []
        for shape, one, other in FORMATS:
            pair = [p for p in (one, other) if p]
            if other and day_first and one.startswith("M"):  # dotted dates begin with the day anyway
                pair.reverse()
            best = max(pair, key=lambda p: votes[shape, p])  # the first of equals
            if votes[shape, best]:
                kept.append((shape, best, votes[shape, best]))
        out[row["column_name"]] = row["n"], sorted(kept, key=lambda f: -f[2])
    return out


def parse_dates(df: DataFrame, cols: Sequence[str] | None = None, least: float = 0.8, day_first: bool = False,
                voted: Mapping[str, tuple[int, list[tuple[str, str, int]]]] | None = None) -> DataFrame:
    """Text columns of which accepted formats read ``least`` of the values become timestamps; other values of them become null.

    Pass ``voted`` to read a table by the formats of another one.
    """
    voted = vote_formats(df, cols, day_first) if voted is None else voted
    new = {}
    for c, (n, formats) in voted.items():
        if n and sum(f[2] for f in formats) >= least * n:
            new[c] = F.coalesce(*[_read(F.trim(as_col(c)), shape, pattern) for shape, pattern, _ in formats])
    return df.withColumns(new) if new else df
