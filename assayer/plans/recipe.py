"""Per-column cleaning recipes compiled to stages, and the cleaning pipeline built from them.

A stage handles ALL columns that need it at once: one fused statistics aggregation, then one select.  The stage
order is fixed: cast, text, constraints, date, impute, outliers, transform, bin, scale, encode, interact, drop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import columns_text as CT
from assayer.functions.values import as_col, clip
from assayer.operators import clean as C
from assayer.operators import encode as E
from assayer.plans.columns import dtype, numeric_columns, text_columns
from assayer.session import cut

Step = Callable[[DataFrame], DataFrame]


@dataclass
class ColumnRecipe:
    """What to do with one column; None or empty means leave alone."""

    drop: bool = False
    cast: str | None = None
    datetime_format: str | None = None
    text: Sequence[str] = ()
    regex: Mapping[str, str] = field(default_factory=dict)
    min_value: float | None = None
    max_value: float | None = None
    allowed: Sequence | None = None
    pattern: str | None = None
    date_conversion: bool = False
    date_parts: Sequence[str] = ()
    impute: str | None = None
    impute_value: object = 0
    outliers: str | None = None
    outlier_threshold: float = 1.5
    transform: str | None = None
    degree: int = 2
    binning: str | None = None
    bins: int = 5
    scale: str | None = None
    encode: str | None = None
    target: str | None = None
    order: Sequence[str] | None = None
    max_categories: int | None = None
    interact_with: Sequence[str] = ()
    custom: Step | None = None


Recipe = Mapping[str, ColumnRecipe]


def _groups(recipe: Recipe, cols: Sequence[str], what: Callable[[ColumnRecipe], object]) -> dict[object, list[str]]:
    out: dict[object, list[str]] = {}
    for c, r in recipe.items():
        if c in cols and what(r):
            out.setdefault(what(r), []).append(c)
    return out


def _scalars(df: DataFrame, recipe: Recipe) -> DataFrame:
    """cast, text, constraints and dates: pure expressions, one projection each."""
    def project(change):
        nonlocal df
        new = {c: change(c, r) for c, r in recipe.items() if c in df.columns}
        df = df.withColumns({c: e for c, e in new.items() if e is not None})

    project(lambda c, r: None if not r.cast else
            CT.cast_datetime(as_col(c), dtype(df, c), r.datetime_format) if r.cast == "datetime" else CT.CASTS[r.cast](as_col(c), dtype(df, c)))
    project(lambda c, r: CT.regex_replace(CT.clean_text(as_col(c), r.text), r.regex) if (r.text or r.regex) and c in text_columns(df) else None)
    project(lambda c, r: clip(as_col(c), F.lit(r.min_value) if r.min_value is not None else None, F.lit(r.max_value) if r.max_value is not None else None)
            if r.min_value is not None or r.max_value is not None else None)
    project(lambda c, r: CT.allowed(as_col(c), r.allowed) if r.allowed else None)
    project(lambda c, r: CT.matching(as_col(c), r.pattern) if r.pattern else None)
    project(lambda c, r: CT.cast_datetime(as_col(c), dtype(df, c), r.datetime_format) if r.date_conversion else None)
    parts = {f"{c}_{p}": CT.DATE_PARTS[p](as_col(c)) for c, r in recipe.items() if c in df.columns for p in r.date_parts}
    return df.withColumns(parts) if parts else df


def apply_recipe(df: DataFrame, recipe: Recipe, order_by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Run a recipe on a table; position-based imputation needs ``order_by``."""
    # Fits read the table again and again: the scalar steps are run once and cut, and never copied into a fit's expressions.
    df = cut(_scalars(df, recipe))
    for method, cols in _groups(recipe, df.columns, lambda r: r.impute).items():
        if method in ("forward_fill", "backward_fill", "interpolate"):
            for c in cols:
                df = C.impute_ordered(df, method, c, order_by, key)
        elif method == "constant":
            df = C.impute(df, "constant", cols, values={c: recipe[c].impute_value for c in cols})
        else:
            df = C.impute(df, method, cols if method == "most_frequent" else numeric_columns(df, cols))
    for (method, limit), cols in _groups(recipe, df.columns, lambda r: r.outliers and (r.outliers, r.outlier_threshold)).items():
        df = C.treat_outliers(df, method, numeric_columns(df, cols), limit)
    for (method, degree), cols in _groups(recipe, df.columns, lambda r: r.transform and (r.transform, r.degree)).items():
        cols = numeric_columns(df, cols)
        df = C.power_transform(df, method, cols) if method in ("boxcox", "yeojohnson") else C.transform(df, method, cols, degree)
    for (method, bins), cols in _groups(recipe, df.columns, lambda r: r.binning and (r.binning, r.bins)).items():
        for c in numeric_columns(df, cols):
            df = (C.bin_equal_width(df, c, bins) if method == "equal_width" else C.bin_kmeans(df, c, bins) if method == "kmeans"
                  else C.bin_quantile(df, c, bins, drop_duplicates=method == "equal_frequency"))
    for method, cols in _groups(recipe, df.columns, lambda r: r.scale).items():
        df = C.scale(df, method, numeric_columns(df, cols))
    encoders = {"onehot": E.one_hot, "label": E.label, "binary": E.binary, "frequency": E.frequency}
    for c, r in recipe.items():
        if r.encode and c in text_columns(df):
            if r.max_categories:
                df = C.bucket_rare(df, c, r.max_categories)
            df = (E.ordinal(df, c, r.order) if r.encode == "ordinal" else E.target(df, c, r.target) if r.encode in ("target", "mean")
                  else encoders[r.encode](df, c))
    pairs = [(c, o) for c, r in recipe.items() for o in r.interact_with if {c, o} <= set(numeric_columns(df))]
    if pairs:
        df = E.interaction(df, pairs)
    for r in recipe.values():
        if r.custom:
            df = r.custom(df)
    return df.drop(*[c for c, r in recipe.items() if r.drop])


class Pipeline:
    """An editable list of named steps, each a function from table to table."""

    def __init__(self, steps: Sequence[tuple[str, Step]] = ()):
        self.steps = list(steps)

    @classmethod
    def standard(cls, recipe: Recipe, outliers: str | None = "iqr", factor: float = 1.5, order_by: Sequence[str] = ()) -> "Pipeline":
        # every later fit reads the table again, so the deduplicating shuffle is run once and cut
        steps: list[tuple[str, Step]] = [("dedup", lambda d: cut(C.dedup(d)))]
        if outliers == "iqr":
            steps.append(("outliers", lambda d: C.remove_outliers_iqr(d, k=factor)))
        elif outliers == "zscore":
            steps.append(("outliers", lambda d: C.remove_outliers_z(d, limit=factor)))
        return cls([*steps, ("recipe", lambda d: apply_recipe(d, recipe, order_by))])

    def add(self, name: str, step: Step, at: int | None = None) -> "Pipeline":
        self.steps.insert(len(self.steps) if at is None else at, (name, step))
        return self

    def remove(self, name: str) -> "Pipeline":
        self.steps = [s for s in self.steps if s[0] != name]
        return self

    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def run(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = df.transform(step)
        return df

    def run_logged(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The cleaned table and a log (step, rows, columns) after every step."""
        rows, shape = [], [(0, "input", len(df.columns))]
        rows.append(df.agg(F.count(F.lit(1)).alias("rows")).withColumn("at", F.lit(0)))
        for i, (name, step) in enumerate(self.steps, 1):
            df = df.transform(step)
            shape.append((i, name, len(df.columns)))
            rows.append(df.agg(F.count(F.lit(1)).alias("rows")).withColumn("at", F.lit(i)))
        counts = rows[0]
        for more in rows[1:]:
            counts = counts.unionByName(more)
        names = df.sparkSession.createDataFrame(shape, "at int, step string, columns int")
        return df, names.join(counts, "at").select("at", "step", "rows", "columns")
