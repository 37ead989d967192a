"""Six-dimension quality scoring and the issue table built from inference, patterns and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import as_col, band, nan_is_missing, number, share, timestamp
from assayer.operators import infer as I
from assayer.operators import patterns as PT
from assayer.operators.profile import duplicate_rows
from assayer.session import cut, settled
from assayer.plans.columns import (
    TEMPORAL, dtype, flat_columns, long_agg, numeric_columns, text_columns, union_all)

# ---- fixed values -------------------------------------------------------------------------
# dimension: (weight, lower bounds of the scores 100, 80, 60, 40; below the last: 20)
DIMENSIONS = {
    "completeness": (.25, (.95, .85, .70, .50)),
    "consistency": (.20, (.98, .90, .75, .60)),
    "accuracy": (.20, (.95, .85, .70, .55)),
    "validity": (.15, (.98, .90, .80, .65)),
    "uniqueness": (.10, (.99, .95, .85, .70)),
    "timeliness": (.10, (.95, .85, .70, .50)),
}
SCORES, FAILING = (100.0, 80.0, 60.0, 40.0), 20.0
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^[\+]?[1-9]?[0-9\s\-\(\)]{7,15}$"
SUSPICIOUS = ("", "nan", "null", "None")
DATE_NAMES = ("date", "time", "created", "updated", "timestamp")
NON_NEGATIVE_NAMES = ("age", "count", "amount")
PERCENT_NAMES = ("percentage", "percent")
PENALTY = {"high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.0}
MISMATCH_PENALTY = {"high": 1.0, "medium": .5, "low": 0.0, "info": 0.0}
# -------------------------------------------------------------------------------------------


def banded(value: Column, dimension: str) -> Column:
    return band(value, list(zip(DIMENSIONS[dimension][1], SCORES)), FAILING)


def grade(score: Column) -> Column:
    return band(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def _by_key(key: Column, values: dict[str, float]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def _n(c: str) -> Column:
    return F.count(as_col(c))


@nan_is_missing
def completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing share per column with its severity."""
    base = long_agg(df, flat_columns(df, cols), {"n_rows": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(as_col(c).isNull())})
    ratio = share(F.col("missing"), F.col("n_rows"))
    return base.select("column_name", "n_rows", "missing", (1 - ratio).alias("completeness"),
                       F.when(ratio > .5, "high").when(ratio > .2, "medium").alias("severity"))


@nan_is_missing
def consistency_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Case and edge-blank consistency per text column with values."""
    base = long_agg(df, text_columns(df, cols), {
        "n": _n, "up": lambda c: F.count_if(as_col(c).rlike("[A-Z]")), "low": lambda c: F.count_if(as_col(c).rlike("[a-z]")),
        "lead": lambda c: F.count_if(as_col(c).startswith(" ")), "trail": lambda c: F.count_if(as_col(c).endswith(" "))}).where("n > 0")
    case, blank = share(F.least("up", "low"), F.col("n")), share(F.col("lead") + F.col("trail"), F.col("n"))
    cs, ws = F.when(case > .1, 1 - case).otherwise(1.0), F.when(blank > .05, 1 - blank).otherwise(1.0)
    return base.select("column_name", cs.alias("case_score"), ws.alias("blank_score"), ((cs + ws) / 2).alias("score"))


@nan_is_missing
def consistency_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of the values of (inferred numeric) text columns made of number characters only."""
    def clean(c: str) -> Column:
        if c in text_columns(df, cols):
            return F.count_if(~as_col(c).rlike(r"[^0-9.\-+eE]"))
        return _n(c)

    base = long_agg(df, flat_columns(df, cols), {"n": _n, "clean": clean}).where("n > 0")
    return base.select("column_name", "n", (F.col("n") - F.col("clean")).alias("odd"), share(F.col("clean"), F.col("n")).alias("score"))


@nan_is_missing
def consistency(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Score per non-empty column: text consistency, and 1 for typed columns."""
    cols = flat_columns(df, cols)
    typed = [c for c in cols if c not in text_columns(df, cols)]
    parts = []
    if text_columns(df, cols):
        parts.append(consistency_text(df, cols).select("column_name", "score"))
    if typed:
        parts.append(consistency_numeric(df, typed).select("column_name", "score"))
    return union_all(parts)


@nan_is_missing
def accuracy(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Valid share per column; the rule (email, phone, date, generic) follows the column name."""
    def rule(c: str) -> str:
        low = c.lower()
        return ("email" if "email" in low else "phone" if "phone" in low
                else "date" if "date" in low or "time" in low else "generic")

    def valid(c: str) -> Column:
        x, k = as_col(c), rule(c)
        text = c in text_columns(df)
        if k == "email":
            return F.count_if(x.cast("string").rlike(EMAIL))
        if k == "phone":
            return F.count_if(F.trim(x.cast("string")).rlike(PHONE))
        if k == "date":
            return F.count_if(timestamp(c, dtype(df, c)).isNotNull())
        return F.count_if(~x.isin(*SUSPICIOUS)) if text else F.count(x)

    base = long_agg(df, flat_columns(df, cols), {"rule": lambda c: F.lit(rule(c)), "n": _n, "valid": valid}).where("n > 0")
    score = share(F.col("valid"), F.col("n"))
    generic = F.col("rule") == "generic"
    return base.select("column_name", "rule", "n", "valid", score.alias("score"),
                       F.when(generic & (score < .95), "low").when(~generic & (score < .9), "medium").alias("severity"))


@nan_is_missing
def validity(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of values obeying the name rules: no negatives, percentages within 0..100."""
    nums = numeric_columns(df)
    num = lambda c: number(c, dtype(df, c))

    def negatives(c: str) -> Column:
        hit = c in nums and any(w in c.lower() for w in NON_NEGATIVE_NAMES)
        return F.count_if(num(c) < 0) if hit else F.lit(0).cast("bigint")

    def out_of_percent(c: str) -> Column:
        hit = c in nums and any(w in c.lower() for w in PERCENT_NAMES)
        return F.count_if((num(c) < 0) | (num(c) > 100)) if hit else F.lit(0).cast("bigint")

    base = long_agg(df, flat_columns(df, cols), {"n": _n, "negative": negatives, "off_percent": out_of_percent}).where("n > 0")
    score = F.greatest(F.lit(0.0), 1 - share(F.col("negative") + F.col("off_percent"), F.col("n")))
    return base.select("column_name", "n", "negative", "off_percent", score.alias("score"),
                       F.when(F.col("off_percent") > 0, "high").when(F.col("negative") > 0, "medium").alias("severity"))


@nan_is_missing
def target_validity(df: DataFrame, target: str) -> DataFrame:
    """One row for a numeric two-valued target: 0.7 when the rarer class is below one percent."""
    classes = df.where(as_col(target).isNotNull()).groupBy(as_col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    facts = classes.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.sum("n").alias("n"))
    minority = share(F.col("lo"), F.col("n"))
    bad = F.lit(target in numeric_columns(df)) & (F.col("k") == 2) & (minority < .01)
    return facts.select(F.lit(target).alias("column_name"), F.col("k").alias("classes"), minority.alias("minority_ratio"),
                        F.when(bad, .7).otherwise(1.0).alias("score"))


@nan_is_missing
def uniqueness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct share per non-empty column; over 95 % is reported as a potential identifier."""
    cols = flat_columns(df, cols)
    base = long_agg(df, cols, {"n": _n}, distinct="u").where("n > 0")
    ratio = share(F.col("u"), F.col("n"))
    return base.select("column_name", "n", F.col("u").alias("unique_count"), ratio.alias("unique_ratio"),
                       F.when(ratio > .95, "info").alias("severity"))


@nan_is_missing
def timeliness(df: DataFrame, as_of: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Age of the newest value of every date-named column that parses for over 80 % of the rows."""
    named = [c for c in flat_columns(df, cols) if any(w in c.lower() for w in DATE_NAMES)
             and (c in text_columns(df) or isinstance(dtype(df, c), TEMPORAL))]
    if not named:
        return df.sparkSession.createDataFrame([], "column_name string, newest timestamp, days_old int, score double, severity string")
    ts = lambda c: timestamp(c, dtype(df, c))
    base = long_agg(df, named, {"rows": lambda c: F.count(F.lit(1)), "parsed": lambda c: F.count(ts(c)), "newest": lambda c: F.max(ts(c))})
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("newest"))
    return base.where(share(F.col("parsed"), F.col("rows")) > .8).select(
        "column_name", "newest", days.alias("days_old"),
        F.when(days <= 1, 1.0).when(days <= 7, .9).when(days <= 30, .8).when(days <= 90, .6).otherwise(.4).alias("score"),
        F.when(days >= 90, "high").when(days > 30, "medium").alias("severity"))


@nan_is_missing
def dimensions(df: DataFrame, as_of: str, target: str | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per dimension: ratio, banded score, weight, grade."""
    cols = flat_columns(df, cols)
    d = df.select(*[as_col(c) for c in cols])
    comp = completeness(d).agg((1 - share(F.sum("missing"), F.sum("n_rows"))).alias("ratio"))
    cons = consistency(d).agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("ratio"))
    acc = accuracy(d).agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("ratio"))
    val = validity(d).select("score")
    if target:
        val = val.unionByName(target_validity(d, target).select("score"))
    val = val.agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("ratio"))
    uni = duplicate_rows(d).select((1 - share(F.col("duplicate_rows"), F.col("n_rows"))).alias("ratio"))
    tim = timeliness(d, as_of).agg(F.avg("score").alias("ratio"))
    parts = []
    for name, part in zip(DIMENSIONS, (comp, cons, acc, val, uni, tim)):
        score = banded(F.col("ratio"), name)
        if name == "timeliness":  # without any date column the dimension gets the "good" score
            score = F.when(F.col("ratio").isNull(), 80.0).otherwise(score)
        parts.append(part.select(F.lit(name).alias("dimension"), "ratio", score.alias("score"),
                                 F.lit(DIMENSIONS[name][0]).alias("weight")))
    return union_all(parts).withColumn("grade", grade(F.col("score")))


def overall(dims: DataFrame) -> DataFrame:
    """Weighted total of a dimension table."""
    score = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    return dims.agg(score.alias("overall_score")).withColumn("grade", grade(F.col("overall_score")))


@nan_is_missing
def confidence(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Trust in the assessment from the number of rows and the completeness."""
    facts = completeness(df, cols).agg(F.max("n_rows").alias("n_rows"), (1 - share(F.sum("missing"), F.sum("n_rows"))).alias("complete"))
    size = F.when(F.col("n_rows") < 100, .6).when(F.col("n_rows") < 1000, .8).otherwise(1.0)
    return facts.select("n_rows", "complete", ((size + F.col("complete")) / 2).alias("confidence"))


ISSUE = ("severity", "column_name", "issue_type")


def _issue(rows: DataFrame, severity: Column, column: Column, issue: Column) -> DataFrame:
    return rows.select(severity.alias("severity"), column.alias("column_name"), issue.alias("issue_type")).where("severity is not null")


def issues_from_types(inferred: DataFrame) -> DataFrame:
    """Low confidence, and an inferred type other than the stored one (compared on one scale of names)."""
    c, name = F.col("confidence"), F.col("column_name")
    stored = F.when(F.col("original_type").isin("integer", "float"), "numeric").otherwise(F.col("original_type"))
    low = _issue(inferred, F.when(c < .4, "medium").when(c < .6, "low"), name, F.lit("low_confidence_type_inference"))
    differs = (F.col("inferred_type") != stored) & (c > .7)
    return low.unionByName(_issue(inferred, F.when(differs, F.when(c > .8, "low").otherwise("info")), name, F.lit("type_mismatch")))


def issues_from_patterns(found: DataFrame) -> DataFrame:
    name = F.col("column_name")
    anomaly = found.where("pattern_type = 'anomaly'")
    ident = found.where("pattern_name = 'unique_identifier'")
    return (_issue(anomaly, F.when(F.col("confidence") > .8, "high").otherwise("medium"), name, F.concat(F.lit("anomaly_"), "pattern_name"))
            .unionByName(_issue(ident, F.lit("info"), name, F.lit("potential_identifier"))))


@nan_is_missing
def issues_from_metrics(df: DataFrame, dims: DataFrame, as_of: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Issues of each dimension's columns and of poor dimensions as a whole."""
    cols = flat_columns(df, cols)
    name, sev = F.col("column_name"), F.col("severity")
    parts = [
        _issue(dims, F.when(F.col("score") < 40, "high").when(F.col("score") < 60, "medium"), F.lit("__dataset__"),
               F.concat(F.lit("poor_"), "dimension", F.lit("_quality"))),
        _issue(completeness(df, cols), sev, name, F.when(sev == "high", "high_missing_data").otherwise("moderate_missing_data")),
        _issue(accuracy(df, cols), sev, name, F.when(F.col("rule") == "generic", "suspicious_values")
               .otherwise(F.concat(F.lit("invalid_"), "rule", F.lit("_format")))),
        _issue(uniqueness(df, cols), sev, name, F.lit("potential_identifier")),
        _issue(timeliness(df, as_of, cols), sev, name, F.lit("stale_data")),
    ]
    val = validity(df, cols)
    parts += [_issue(val, F.when(F.col("negative") > 0, "medium"), name, F.lit("invalid_negative_values")),
              _issue(val, F.when(F.col("off_percent") > 0, "high"), name, F.lit("invalid_percentage_range"))]
    if text_columns(df, cols):
        txt = consistency_text(df, cols)
        parts += [_issue(txt, F.when(F.col("case_score") < 1, "low"), name, F.lit("case_inconsistency")),
                  _issue(txt, F.when(F.col("blank_score") < 1, "low"), name, F.lit("whitespace_inconsistency"))]
    return union_all(parts)


def cross_check(inferred: DataFrame, found: DataFrame) -> DataFrame:
    """Columns inferred numeric although an email or phone format was found."""
    hits = found.where(F.col("pattern_name").isin("email", "phone")).select("column_name").distinct()
    numeric = inferred.where("inferred_type = 'numeric'").select("column_name")
    return _issue(numeric.join(F.broadcast(hits), "column_name"), F.lit("medium"), F.col("column_name"), F.lit("type_pattern_conflict"))


def penalised(issues: DataFrame, base: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score of the table (base minus penalties) and of every column (100 minus penalties), never below zero."""
    mismatch = F.col("issue_type") == "type_mismatch"
    full = _by_key(F.col("severity"), PENALTY)
    cost = F.when(mismatch, _by_key(F.col("severity"), MISMATCH_PENALTY)).otherwise(full)
    whole = issues.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("p")).crossJoin(F.broadcast(base)).select(
        F.lit("__overall__").alias("column_name"), F.greatest(F.lit(0.0), F.col("overall_score") - F.col("p")).alias("score"))
    names = issues.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    per = issues.groupBy("column_name").agg(F.sum(full).alias("p"))
    each = names.join(F.broadcast(per), "column_name", "left").select(
        "column_name", F.greatest(F.lit(0.0), 100 - F.coalesce("p", F.lit(0.0))).alias("score"))
    return whole.unionByName(each)


def advice(score: Column, high: Column, medium: Column, bounds: tuple[float, float, float] = (40, 70, 85)) -> Column:
    """Advice codes in stable order for a final score and the numbers of high and medium issues."""
    lo, mid, hi = bounds
    band_ = F.when(score < lo, "critical_remediation").when(score < mid, "fix_before_production") \
        .when(score < hi, "minor_issues").otherwise("acceptable")
    return F.array_join(F.array_compact(F.array(band_, F.when(high > 0, "address_high_issues"),
                                                F.when(medium > 5, "consider_medium_issues"))), ",")


@nan_is_missing
def assess(df: DataFrame, as_of: str, target: str | None = None, cols: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Inference, patterns, dimensions, issues and scores of a table, each as a table."""
    cols = flat_columns(df, cols)
    df = settled(df if len(cols) == len(df.columns) else df.select(*[as_col(c) for c in cols]))
    # each result is a handful of rows per column; cut once, read by several of the tables below
    inferred, found = cut(I.infer(df, cols)), cut(PT.detect(df, cols))
    dims = cut(dimensions(df, as_of, target, cols))
    issues = cut(union_all([issues_from_types(inferred), issues_from_patterns(found),
                        issues_from_metrics(df, dims, as_of, cols), cross_check(inferred, found)]))
    return {"inference": inferred, "patterns": found, "dimensions": dims, "issues": issues,
            "scores": penalised(issues, overall(dims), cols)}


@nan_is_missing
def basic_assessment(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Issue rows of the short assessment plus the overall row (100 minus penalties) and the completeness row."""
    cols = flat_columns(df, cols)
    texts = text_columns(df, cols)
    base = long_agg(df, cols, {"n": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(as_col(c).isNull()),
                               "is_text": lambda c: F.lit(c in texts)}, distinct="u")
    ratio, uniq = share(F.col("missing"), F.col("n")), share(F.col("u"), F.col("n"))
    issues = (_issue(base, F.when(ratio > .5, "high").when(ratio > .1, "medium"), F.col("column_name"), F.lit("missing_data"))
              .unionByName(_issue(base, F.when(F.col("is_text") & (uniq > .95), "info"), F.col("column_name"), F.lit("potential_identifier"))))
    total = issues.agg(F.coalesce(F.sum(_by_key(F.col("severity"), PENALTY)), F.lit(0.0)).alias("p"))
    done = base.agg((100 * (1 - share(F.sum("missing"), F.sum("n")))).alias("v"))
    null_s = F.lit(None).cast("string")
    return (issues.withColumn("value", F.lit(None).cast("double"))
            .unionByName(total.select(null_s.alias("severity"), F.lit("__dataset__").alias("column_name"), F.lit("overall_score").alias("issue_type"),
                                      F.greatest(F.lit(0.0), 100 - F.col("p")).alias("value")))
            .unionByName(done.select(null_s.alias("severity"), F.lit("__dataset__").alias("column_name"),
                                     F.lit("completeness").alias("issue_type"), F.col("v").alias("value"))))


@nan_is_missing
def validate(df: DataFrame, id_rows: int = 100) -> DataFrame:
    """Empty table (critical), all-null columns (error), identifier-like columns of larger tables (warning)."""
    cols = flat_columns(df)
    base = long_agg(df, cols, {"rows": lambda c: F.count(F.lit(1)), "n": _n}, distinct="u")
    empty = base.agg(F.max("rows").alias("rows")).where("rows = 0")
    is_null = (F.col("rows") > 0) & (F.col("n") == 0)
    is_id = (F.col("rows") > id_rows) & (F.col("u") == F.col("rows"))
    return (_issue(empty, F.lit("critical"), F.lit("__dataset__"), F.lit("empty_table"))
            .unionByName(_issue(base, F.when(is_null, "error"), F.col("column_name"), F.lit("all_null")))
            .unionByName(_issue(base, F.when(is_id, "warning"), F.col("column_name"), F.lit("identifier_like"))))
