"""Cast, text, constraint and date expressions: one column in, one column out, null stays null."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.values import number, timestamp, title_case

# ---- fixed values: strptime directives and their Spark pattern letters -----------------------
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM"}
# -------------------------------------------------------------------------------------------


def cast_int(c: Column, t: T.DataType) -> Column:
    """Integer reading; unparsable and non-integral values become null."""
    v = number(c, t)
    return F.when(v == F.floor(v), F.floor(v))


def cast_float(c: Column, t: T.DataType) -> Column:
    return number(c, t)


def cast_str(c: Column, t: T.DataType) -> Column:
    return c.cast("string")


def cast_bool(c: Column, t: T.DataType) -> Column:
    """Truth of a value: any non-empty text, any non-zero number."""
    if isinstance(t, T.BooleanType):
        return c
    return (F.length(c) > 0) if isinstance(t, T.StringType) else (c != 0)


def cast_datetime(c: Column, t: T.DataType, fmt: str | None = None) -> Column:
    if fmt is None or not isinstance(t, T.StringType):
        return timestamp(c, t)
    for directive, letters in DIRECTIVES.items():
        fmt = fmt.replace(directive, letters)
    return F.try_to_timestamp(c, F.lit(fmt))


CASTS = {"int": cast_int, "float": cast_float, "str": cast_str, "bool": cast_bool, "datetime": cast_datetime}

TEXT = {
    "strip": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "lower": F.lower,
    "upper": F.upper,
    "title": title_case,
    "remove_digits": lambda c: F.regexp_replace(c, r"\d+", ""),
    "remove_punctuation": lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", ""),
    "remove_extra_spaces": lambda c: F.regexp_replace(c, r"\s+", " "),
    "currency_to_numeric": lambda c: F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double"),  # null if no number is left
}


def clean_text(c: Column, operations: Sequence[str]) -> Column:
    for op in operations:
        c = TEXT[op](c)
    return c


def regex_replace(c: Column, rules: Mapping[str, str]) -> Column:
    """Replacements in order; ``\\1`` group references are accepted."""
    import re

    for pattern, replacement in rules.items():
        c = F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", replacement))
    return c


def allowed(c: Column, values: Sequence) -> Column:
    return F.when(c.isin(*values), c)


def matching(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), c)


DATE_PARTS = {
    "year": F.year, "month": F.month, "day": F.day, "dayofweek": F.weekday, "quarter": F.quarter,
    "hour": F.hour, "minute": F.minute,
    "is_weekend": lambda c: F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)),
}


def cyclic(c: Column, prefix: str, hours: bool) -> dict[str, Column]:
    """Sine and cosine of month, day of week and, when asked, hour."""
    turns = {"month": F.month(c) / 12, "dow": F.weekday(c) / 7}
    if hours:
        turns["hour"] = F.hour(c) / 24
    out = {}
    for name, turn in turns.items():
        angle = turn * (2 * math.pi)
        out[f"{prefix}_{name}_sin"], out[f"{prefix}_{name}_cos"] = F.sin(angle), F.cos(angle)
    return out
