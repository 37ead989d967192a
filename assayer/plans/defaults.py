"""What a recipe leaves open, filled from the state of the table: imputation, scaling and encoding of all other columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import as_col, number
from assayer.plans.columns import dtype, flat_columns, long_agg, numeric_columns, text_columns
from assayer.plans.recipe import ColumnRecipe, Recipe

SKEWED = 1.0
MOSTLY_MISSING = 0.5


def complete(df: DataFrame, recipe: Recipe | None = None, keep: Sequence[str] = (), impute_num: str | None = "auto", impute_cat: str | None = "auto",
             constant: object = "missing", scaling: str | None = "standard", encoding: str | None = "onehot", max_cardinality: int = 20) -> dict[str, ColumnRecipe]:
    """``recipe`` with a choice for every column and step it says nothing about; None switches a step off, ``keep`` stays as it is.

    ``auto`` takes the mean, or the median where the skewness is beyond SKEWED; the most frequent text, or ``constant`` where
    more than MOSTLY_MISSING is missing.  Texts of more than ``max_cardinality`` values are not encoded.  One record of counts,
    moments and distinct counts of the open columns decides.
    """
    out = dict(recipe or {})
    cols = [c for c in flat_columns(df) if c not in keep and not (c in out and out[c].drop)]
    nums, texts = set(numeric_columns(df, cols)), set(text_columns(df, cols))
    cols = [c for c in cols if c in nums | texts]
    if not cols:
        return out
    record = long_agg(df, cols, {
        "rows": lambda c: F.count(F.lit(1)), "present": lambda c: F.count(as_col(c)),
        "skew": lambda c: F.nanvl(F.skewness(number(c, dtype(df, c))), F.lit(None)) if c in nums else F.lit(None).cast("double")}, distinct="unique_count")
    for state in record.collect():  # a row per column
        c = state["column_name"]
        own = out.get(c, ColumnRecipe())
        gaps, change = state["rows"] - state["present"], {}
        if gaps and not own.impute and (impute_num if c in nums else impute_cat):
            method = impute_num if c in nums else impute_cat
            if method == "auto" and c in nums:
                method = "median" if abs(state["skew"] or 0.0) > SKEWED else "mean"
            elif method == "auto":
                method = "constant" if gaps > MOSTLY_MISSING * state["rows"] else "most_frequent"
            change["impute"] = method
            if method == "constant":
                change["impute_value"] = constant
        if c in nums and scaling and not own.scale:
            change["scale"] = scaling
        if c in texts and encoding and not own.encode and state["unique_count"] <= max_cardinality:
            change["encode"] = encoding
        if change:
            out[c] = replace(own, **change)
    return out
