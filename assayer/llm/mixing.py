"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its size.  Each document's count is the Poisson
quantile, at that mean, of a uniform number hashed from its key, so that any partitioning and any retry gives the same
copies; the copies are then dealt out by a hash, which is the global shuffle.  Hashes are even, so their ranges are known
without a sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.distributions import normal_quantile
from assayer.functions.values import as_col
from assayer.llm.common import text_of
from assayer.plans.lookup import lookup_join

# 60 hexadecimal bits of an MD5 as a number from 0 to 1; a double rounds it, never to above 1.
HEX_DIGITS = 15
#: From this rate on the quantile comes from an expansion around the normal one, not from the distribution function.
LARGE_RATE = 1000
#: Copies of a document are made so many at a time.
BLOCK_COPIES = 4096


def hashed_uniform(*parts: Column) -> Column:
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** HEX_DIGITS)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0,
                 source: str = "source") -> DataFrame:
    """One row per source: __source, chars, rate.

    ``weights`` are target shares of the output's characters (sources that it does not name get none); None gives every
    source the same share.  ``epochs`` is the size of the output against the input.  A source without characters keeps
    rate 0.  Null is a source of its own only as the empty name: null and '' are one source.
    """
    sizes = (docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), F.length(text_of()).alias("n"))
             .groupBy("__source").agg(F.sum("n").alias("chars")))
    if weights is None:
        weighed = sizes.withColumn("__w", F.lit(1.0))
    else:
        if not weights or min(weights.values()) < 0 or not sum(weights.values()):
            raise ValueError("weights must be positive")
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__source string, __w double")
        weighed = lookup_join(sizes, named, ["__source"]).fillna(0.0, ["__w"])
    weighed = weighed.withColumn("__w", F.when(F.col("chars") > 0, F.col("__w")).otherwise(0.0))
    total = weighed.agg(F.sum("chars").alias("__all"), F.sum("__w").alias("__ws"))  # one row
    return weighed.crossJoin(F.broadcast(total)).select(
        "__source", "chars",
        F.when((F.col("__w") > 0), epochs * F.col("__all") * F.col("__w") / F.col("__ws") / F.col("chars")).otherwise(0.0).alias("rate"))


def poisson_counts(rates: DataFrame) -> DataFrame:
    """Add ``cdf``: the distribution function of Poisson(rate) at 0, 1, ... until its tail is below what a hash can hit.

    Rates of ``LARGE_RATE`` or more, which ``drawn_count`` treats otherwise, get an empty one.
    """
    rate = F.least(F.col("rate"), F.lit(float(LARGE_RATE)))
    steps = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    # log p(k) = k log(rate) - rate - log k!; log k! by a running sum, so that no factorial overflows
    logs = F.transform(F.sequence(F.lit(0), steps), lambda k: F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0))
    grown = F.aggregate(logs, F.struct(F.array().cast("array<double>").alias("cdf"), F.lit(0.0).alias("f"), F.lit(0.0).alias("s"),
                                       F.lit(0).alias("k")),
                        lambda a, x: _step(a, x), lambda a: a["cdf"])
    return rates.withColumn("cdf", F.when(F.col("rate") >= LARGE_RATE, F.array().cast("array<double>"))
                            .when(F.col("rate") > 0, grown).otherwise(F.array(F.lit(1.0))))


def _step(a: Column, x: Column) -> Column:
    f = a["f"] + x
    s = a["s"] + F.exp(a["k"].cast("double") * F.log(F.col("rate")) - F.col("rate") - f)
    return F.struct(F.concat(a["cdf"], F.array(s)).alias("cdf"), f.alias("f"), s.alias("s"), (a["k"] + 1).alias("k"))


def drawn_count(u: Column) -> Column:
    """The Poisson quantile (long) at ``u`` of rows with rate and cdf.

    Below ``LARGE_RATE`` it is exact to the double.  From there on it is the Cornish-Fisher expansion of third order with the
    half of a step that a count stands for; it may be one count beside the exact quantile where that is at a step's edge.
    """
    z = normal_quantile(F.least(u, F.lit(1 - 2.0 ** -53)))
    root = F.sqrt("rate")
    near = F.col("rate") + root * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * root)
    return F.when(F.col("rate") >= LARGE_RATE, F.greatest(F.ceil(near - 0.5), F.lit(0)).cast("long")).otherwise(
        F.size(F.filter("cdf", lambda c: c < u)).cast("long"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = 42,
                key: Sequence[str] = ("doc_id",), source: str = "source") -> DataFrame:
    """Documents with ``copy`` (0, 1, ..., long) and ``shuffle_key``, each as often as its Poisson count, globally shuffled.

    Counts depend on ``key`` and ``seed`` alone: rows with equal keys (repeated rows) get equal counts, each of them its own
    copies; null keys hash as the empty text.  Empty texts weigh nothing, but are drawn at their source's rate.  Columns
    named copy or shuffle_key are replaced, others come as they are, whatever their names.  An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rates = poisson_counts(source_rates(docs, weights, epochs, source)).select("__source", "rate", "cdf")
    ids = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    keyed = docs.select(F.struct(*map(as_col, columns)).alias("doc"), ids.alias("ids"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"))
    drawn = (lookup_join(keyed, rates, ["__source"], "inner").withColumn("u", hashed_uniform(F.lit(seed), F.col("ids")))
             .select("doc", "ids", drawn_count(F.col("u")).alias("n")))
    # no row where nothing is drawn; of many copies a block at a time is in memory
    first = F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK_COPIES).cast("long"))))
    copies = (drawn.select("doc", "ids", "n", first.alias("first"))
              .select("doc", "ids", F.explode(F.sequence("first", F.least(F.col("first") + BLOCK_COPIES, F.col("n")) - 1)).alias("copy"))
              .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), "ids", F.col("copy").cast("string")))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * parts / float(16 ** 8)).cast("int")
    return (copies.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("shuffle_key")
            .select(*[F.col("doc").getField(c).alias(c) for c in columns], "copy", "shuffle_key"))
