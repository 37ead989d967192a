"""CSV and report sources and sinks: delimiter detection, encoding fallback, named output formats."""

from __future__ import annotations

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans.columns import text_columns

# ---- fixed values -------------------------------------------------------------------------
DELIMITERS = (",", ";", "\t", "|")
PRESETS = {
    "quoted_semicolon": {"sep": ";", "quoteAll": True},
    "clean_semicolon": {"sep": ";"},
    "standard_csv": {"sep": ","},
    "tab_separated": {"sep": "\t"},
    "pipe_separated": {"sep": "|"},
    "no_quotes": {"sep": ";", "quote": "", "escape": "\\"},
}
# -------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8", infer: bool = True, schema: str | None = None) -> DataFrame:
    """CSV with a header line; pass ``schema`` to save the pass over the data that inference takes."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).csv(path)


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    row = spark.read.option("encoding", encoding).text(path).first()
    return row["value"] if row else ""


def detect_delimiter(spark: SparkSession, path: str, default: str = ",", rule: str = "most") -> str:
    """The delimiter of the header line, by one of three rules.

    most: the most frequent (first in the fixed order on ties).  semicolon_or_comma: the more frequent of the two.
    first_that_splits: the semicolon, then the comma, if it gives more than one column, else the most frequent.
    """
    head = first_line(spark, path)
    if rule == "semicolon_or_comma":
        return ";" if head.count(";") > head.count(",") else ","
    if rule == "first_that_splits":
        for sep in (";", ","):
            if sep in head:
                return sep
    elif rule != "most":
        raise ValueError(f"unknown rule {rule}")
    best = max(DELIMITERS, key=head.count)
    return best if head.count(best) else default


def read_csv_auto(spark: SparkSession, path: str, default: str = ",", rule: str = "most", **kw) -> DataFrame:
    return read_csv(spark, path, detect_delimiter(spark, path, default, rule), **kw)


def read_csv_fallback(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """UTF-8, or Latin-1 when the bytes are not UTF-8; semicolons when ``sep`` leaves a single column."""
    broken = spark.read.text(path).agg(F.max((~F.is_valid_utf8("value")).cast("int")).alias("bad")).first()["bad"] or 0
    encoding = "ISO-8859-1" if broken > 0 else "UTF-8"
    df = read_csv(spark, path, sep, encoding)
    return read_csv(spark, path, ";", encoding) if len(df.columns) == 1 and sep != ";" else df


def sanitise_unquoted(df: DataFrame, sep: str = ";") -> DataFrame:
    """Text made safe for output without quotes: delimiter to underscore, quotes removed."""
    return df.withColumns({c: F.translate(F.replace(F.col(c), F.lit(sep), F.lit("_")), "'\"", "") for c in text_columns(df)})


def write_csv(df: DataFrame, path: str, preset: str | None = None, sep: str = ",", quoting: str = "minimal", quote: str = '"',
              escape: str = '"', encoding: str = "UTF-8", line_sep: str = "\n") -> bool:
    """CSV by preset or by options; ``quoting`` is minimal, all or none.  False: the options didn't fit, it is plain CSV."""
    opts = dict(PRESETS[preset]) if preset else {"sep": sep, "quoteAll": quoting == "all", "quote": "" if quoting == "none" else quote, "escape": escape}
    if opts.get("quote") == "":
        df = sanitise_unquoted(df, str(opts["sep"]))
        opts["quote"] = "\u0000"
        opts.pop("escape", None)
    writer = df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("lineSep", line_sep)
    for k, v in opts.items():
        writer = writer.option(k, v)
    try:
        writer.csv(path)
        return True
    except (AnalysisException, IllegalArgumentException):  # options or types that the format can't take; any other failure is raised
        df.write.mode("overwrite").option("header", True).option("sep", ",").csv(path)
        return False


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """Every result table under its name, as JSON lines or Parquet."""
    for name, df in tables.items():
        getattr(df.write.mode("overwrite"), fmt)(f"{path}/{name}")
