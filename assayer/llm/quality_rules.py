"""Quality rules with host-level verdicts, in column expressions only.

Each document is measured once.  Failures are added up per host, the host's failure rate is shrunk towards the corpus by a
beta prior fitted to all hosts (method of moments), and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import stored, text_of
from assayer.plans.lookup import lookup_join

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
STRICT_RATE = 0.5
BLOCKED_RATE = 0.95


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, rule_failed.

    Null texts have no words.  Windows of a text are compared by their 64-bit hashes, sorted only in texts where any repeats.
    Columns of these names are replaced.
    """
    own = text_of(text)
    bare = F.btrim(own, F.lit(SPACE))
    split = docs.withColumn("__words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)))
    at = lambda i: F.get("__words", i)
    hashes = F.transform("__words", lambda w, i: F.xxhash64(w, *[at(i + k) for k in range(1, WINDOW)]))
    n = F.size("__words")
    hashed = split.withColumn("__hashes", F.slice(hashes, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.withColumn("__ordered", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(placed)).otherwise(none))
    same = lambda x, i: F.get("__ordered", i)["h"].eqNullSafe(x["h"])
    twice = F.filter("__ordered", lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = ordered.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("__starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", i + 1) - p, F.lit(WINDOW))).cast("long"))
    lines = F.filter(F.split(own, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    lined = starts.withColumn("__lines", lines)
    out = lined.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", "__words")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(own, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
    }).drop("__words", "__hashes", "__ordered", "__starts", "__lines")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = [base, 10 * F.col("n_symbols") > F.col("word_chars"), 2 * F.col("n_dup_lines") > F.col("n_lines"),
             F.col("word_chars") > 25 * F.col("n_words")]
    return out.withColumns({"base_failed": base, "rule_failed": _any(rules)})


def _any(rules: list[Column]) -> Column:
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def host_verdicts(flagged: DataFrame, host: str = "source", strict: float = STRICT_RATE, blocked: float = BLOCKED_RATE) -> DataFrame:
    """__host, docs, failed, rate, shrunk, verdict ('trusted', 'strict', 'blocked') from rows with rule_failed.

    The prior's mean and weight match the mean and the variance, beyond chance, of the hosts' rates; hosts that don't differ
    beyond chance are shrunk all the way.  A null host is the empty one.
    """
    tally = (flagged.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"))
             .agg(F.count("*").alias("docs"), F.sum(F.col("rule_failed").cast("long")).alias("failed")))
    # sums of whole numbers first, so that the order of adding doesn't show
    total = tally.agg(F.count("*").alias("__k"), F.sum("docs").alias("__n"), F.sum("failed").alias("__f"),
                      F.sum((F.col("docs") * F.col("docs")).cast("decimal(38,0)")).cast("double").alias("__nn"))
    mean = F.col("__f") / F.col("__n")
    spread = tally.crossJoin(F.broadcast(total)).select(
        F.round(F.sum(F.col("docs") * F.pow(F.col("failed") / F.col("docs") - mean, F.lit(2.0))), 6).alias("__ss"))
    moments = total.crossJoin(F.broadcast(spread)).select(
        mean.alias("__m"),
        (F.greatest(F.col("__ss") - (F.col("__k") - 1) * mean * (1 - mean), F.lit(0.0))
         / F.nullif(F.col("__n") - F.col("__nn") / F.col("__n"), F.lit(0.0))).alias("__v"))
    # beta(m w, (1 - m) w) has variance m (1 - m) / (w + 1)
    weight = F.greatest(F.col("__m") * (1 - F.col("__m")) / F.col("__v") - 1, F.lit(1.0))
    shrunk = F.when(F.coalesce(F.col("__v"), F.lit(0.0)) <= 0, F.col("__m")).otherwise(
        (F.col("failed") + weight * F.col("__m")) / (F.col("docs") + weight))
    return tally.crossJoin(F.broadcast(moments)).select(
        "__host", "docs", "failed", (F.col("failed") / F.col("docs")).alias("rate"), shrunk.alias("shrunk"),
        F.when(shrunk >= blocked, "blocked").when(shrunk >= strict, "strict").otherwise("trusted").alias("verdict"))


def judged(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", strict: float = STRICT_RATE,
           blocked: float = BLOCKED_RATE) -> DataFrame:
    """``keep`` columns of ``docs`` with the measures, host_rate (shrunk), verdict and kept.

    The base rules always reject.  A strict host's documents must pass every rule; a blocked host loses all of them; a
    trusted host's other failures are let through.  Repeated rows count as often as they come; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed"]
    columns = [c for c in keep if c not in [*names, "host_rate", "verdict", "kept", "__host"]]
    wanted = list(dict.fromkeys([*columns, host, text]))
    slim = measured(docs.select(*wanted), text)
    flagged = stored(slim.select(*columns, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"), *names), "measured")
    verdicts = host_verdicts(flagged, "__host", strict, blocked).select("__host", F.col("shrunk").alias("host_rate"), "verdict")
    passed = F.when(F.col("base_failed") | (F.col("verdict") == "blocked"), False).when(F.col("verdict") == "strict", ~F.col("rule_failed")).otherwise(True)
    return lookup_join(flagged, verdicts, ["__host"]).withColumn("kept", passed).drop("__host")
