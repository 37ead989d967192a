"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, in column expressions only.

A text's paragraphs are its lines; a long line is cut after 24, 96 and then every 512 characters from its start, so that an
edit changes few of them.  A sketch has three tables of 2^q cells; a digest stands in one cell of each, and a cell holds a
count, the XOR of its digests and the XOR of their checks.  Sketches of two versions subtract cell by cell; what is left
holds only the digests that differ, and is peeled: a cell with one digest names it, and taking it out of its other cells
frees the next.  Pairs that can't be peeled are tried again with twice the cells.  As only cells that hold something are
rows, and all cells of a pair are in one partition, peeling needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import range_of, range_tops, stored, text_of

TABLES = 3
SHOWN_Q = 2  # the printed fingerprint has 3 x 4 cells
LEAST_Q = 3
ROUNDS = 15
HEAD, SECOND, REST = 24, 72, 512


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs; blank ones have none."""
    def pieces(line: Column) -> Column:
        rest = F.regexp_extract_all(F.substring(line, F.lit(HEAD + SECOND + 1), F.length(line)), F.lit(f".{{1,{REST}}}"), 0)
        return F.concat(F.array(F.substring(line, 1, HEAD), F.substring(line, HEAD + 1, SECOND)), rest)

    cut = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.when(
        F.length(line) > HEAD + SECOND, pieces(line)).otherwise(F.array(F.substring(line, 1, HEAD), F.substring(line, HEAD + 1, SECOND)))))
    return F.array_distinct(F.transform(F.filter(cut, lambda p: p != ""), lambda p: F.xxhash64(p)))


def cell_of(digest: Column, t: int, q: Column | int) -> Column:
    """The digest's cell in table t (cells are numbered 3 i + t); a sketch of fewer cells is a folded one of more."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(q) if isinstance(q, int) else q)
    return F.xxhash64(digest, F.lit(t)).bitwiseAND(mask - 1) * TABLES + t


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def printed(found: Column) -> Column:
    """The sketch of an array of digests as text: per cell 4 hexadecimal digits of count, 16 of digests, 8 of checks."""
    def cell(j: Column) -> Column:
        own = F.filter(found, lambda d: (cell_of(d, 0, SHOWN_Q) == j) | (cell_of(d, 1, SHOWN_Q) == j) | (cell_of(d, 2, SHOWN_Q) == j))
        zero = F.lit(0).cast("long")
        keys = F.aggregate(own, zero, lambda a, d: a.bitwiseXOR(d))
        checks = F.aggregate(own, zero, lambda a, d: a.bitwiseXOR(check_of(d)))
        return F.concat(F.lpad(F.hex(F.size(own)), 4, "0"), F.lpad(F.hex(keys), 16, "0"), F.substring(F.lpad(F.hex(checks), 16, "0"), 9, 8))

    return F.array_join(F.transform(F.array(*[F.lit(j).cast("long") for j in range(TABLES << SHOWN_Q)]), cell), "")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, found, next_text, next_found, key for every row: the text that follows by descending doc_id.

    After the last comes the first; of equal ids the order is that of the texts; rows without an id come last.  Ranges of
    doc_id are cut so that each is one partition; a range also gets the last row of the range below it.  ``key`` is unique.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    tops = range_tops(slim, "doc_id", parts)
    n = max(1, len(tops))
    here = range_of(F.col("doc_id"), tops)
    is_top = F.col("doc_id") == F.get(F.lit(tops or [0]).cast("array<bigint>"), here)
    copies = F.array(F.struct(here.alias("part"), F.lit(1).alias("own")), F.struct(((here + 1) % n).cast("int").alias("part"), F.lit(0).alias("own")))
    dealt = (slim.withColumn("found", digests(F.col("text")))
             .select("*", F.explode(F.when(F.coalesce(is_top, F.lit(False)), copies).otherwise(F.slice(copies, 1, 1))).alias("__to"))
             .select("doc_id", "text", "found", F.col("__to.part").alias("part"), F.col("__to.own").alias("own")))
    w = Window.partitionBy("part").orderBy("own", F.col("doc_id").asc_nulls_first(), "text")
    return (dealt.repartitionById(n, "part")
            .withColumns({"next_text": F.lag("text").over(w), "next_found": F.lag("found").over(w), "__n": F.row_number().over(w)})
            .where("own = 1")
            .select("doc_id", "text", "found", F.coalesce("next_text", F.lit("")).alias("next_text"),
                    F.coalesce("next_found", F.array().cast("array<bigint>")).alias("next_found"),
                    (F.col("part").cast("long") * F.lit(1 << 40) + F.col("__n")).alias("key")))


def _peeled(pairs: DataFrame, keep: bool) -> DataFrame:
    """key, pair, left (cells that stay), n_found; with ``keep`` a row per recovered digest: key, pair, digest, side.

    ``pairs``: key, pair, q, a, b, in partitions by key.
    """
    group = ["key", "pair", "q", "cell", "own"]
    signed = lambda side, n: F.transform(side, lambda d: F.struct(d.alias("d"), F.lit(n).cast("long").alias("n")))
    each = pairs.select("key", "pair", "q", F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("__e")).select(
        "key", "pair", "q", F.col("__e.d").alias("k"), F.col("__e.n").alias("n"))

    def row(cell: Column, own: Column, n: Column, k: Column, h: Column) -> Column:
        return F.struct(cell.cast("long").alias("cell"), own.cast("long").alias("own"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"))

    zero = F.lit(0).cast("long")

    def summed(rows: DataFrame) -> DataFrame:
        return (rows.select("key", "pair", "q", "__r.*").groupBy(*group)
                .agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
                .where("cell < 0 OR n <> 0 OR k <> 0 OR h <> 0"))

    cells = summed(each.withColumn("__h", check_of(F.col("k"))).select("key", "pair", "q", F.explode(F.array(
        *[row(cell_of(F.col("k"), t, F.col("q")), zero, F.col("n"), F.col("k"), F.col("__h")) for t in range(TABLES)])).alias("__r")))
    for r in range(ROUNDS):
        t = r % TABLES  # of one table at a time, so that a digest is taken out once
        pure = (F.col("cell") >= 0) & (F.col("cell") % TABLES == t) & (F.abs("n") == 1) & (F.col("h") == check_of(F.col("k")))
        out = [row(cell_of(F.col("k"), u, F.col("q")), zero, -F.col("n"), F.col("k"), F.col("h")) for u in range(TABLES) if u != t]
        told = row(F.lit(-1), F.col("k"), F.col("n"), zero, zero) if keep else row(F.lit(-1), zero, F.lit(1), zero, zero)
        same = row(F.col("cell"), F.col("own"), F.col("n"), F.col("k"), F.col("h"))
        cells = summed(cells.select("key", "pair", "q", F.explode(F.when(pure, F.array(*out, told)).otherwise(F.array(same))).alias("__r")))
    if keep:
        return cells.where("cell < 0").select("key", "pair", F.col("own").alias("digest"), F.when(F.col("n") > 0, "a").otherwise("b").alias("side"))
    return cells.groupBy("key", "pair").agg(F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0)).alias("left"),
                                            F.coalesce(F.sum(F.when(F.col("cell") < 0, F.col("n"))), zero).alias("n_found"))


def _sized(pairs: DataFrame, larger: int) -> DataFrame:
    """Add q: cells for twice the digests of both sides, doubled ``larger`` times."""
    need = F.greatest(F.size("a") + F.size("b"), F.lit(1)).cast("double") * 2 / TABLES
    return pairs.withColumn("q", F.greatest(F.ceil(F.log2(need)), F.lit(LEAST_Q)).cast("int") + larger)


def _attempt(pairs: DataFrame, larger: int, keep: bool = False) -> DataFrame:
    return _peeled(_sized(pairs, larger), keep)


def differences(pairs: DataFrame, tries: int = 12) -> DataFrame:
    """key, pair, n_found: how many digests differ between the arrays ``a`` and ``b``, by subtracting and peeling sketches.

    ``pairs``: key (long), versions: array of (pair, a, b).  Pairs that don't differ come back with 0.
    """
    each = lambda df: df.select("key", F.explode("versions").alias("__v")).select("key", "__v.*")
    todo, done = pairs, None
    for larger in range(tries):
        got = stored(_attempt(each(todo.repartition("key")), larger), "peeled")
        good = got.where("left = 0").select("key", "pair", "n_found")
        done = good if done is None else done.unionByName(good)
        failed = got.where("left > 0").select("key", "pair")
        if failed.isEmpty():
            return done
        open_pairs = each(pairs.join(failed.select("key").distinct(), "key", "left_semi")).join(failed, ["key", "pair"])
        todo = open_pairs.groupBy("key").agg(F.collect_list(F.struct("pair", "a", "b")).alias("versions"))  # two at most
    raise RuntimeError(f"sketches of {failed.count()} pairs can't be peeled")


def recovered(pairs: DataFrame, larger: int = 0) -> DataFrame:
    """key, pair, digest, side: the digests that only ``a`` or only ``b`` has (of pairs that peel at this size)."""
    each = pairs.repartition("key").select("key", F.explode("versions").alias("__v")).select("key", "__v.*")
    return _attempt(each, larger, keep=True)


def version_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text has its last third (rounded down, in code points) put as the start of the text that follows by
    descending doc_id.  Likeness is 1 less the differing digests over all digests of both sides, 1 for two texts without
    any.  Null texts are empty; repeated rows give a row each; rows without doc_id come last in the order; a table where no
    row has one gives the last row an empty text to follow; an empty table gives no rows; other columns are not read.
    """
    n = F.length("text")
    third = (n - n % 3) / 3
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third.cast("int")))
    rows = with_next(docs).withColumn("edited", edited)
    base = stored(rows.select("key", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "found",
                              digests(F.col("edited")).alias("edited_found"), "next_found"), "versions")
    versions = F.array(F.struct(F.lit(0).alias("pair"), F.col("found").alias("a"), F.col("edited_found").alias("b")),
                       F.struct(F.lit(1).alias("pair"), F.col("found").alias("a"), F.col("next_found").alias("b")))
    got = differences(base.select("key", versions.alias("versions")))
    by_key = got.groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("pair") == p, F.col("n_found"))), F.lit(0)).alias(f"d{p}") for p in (0, 1)])

    def likeness(d: str, other: str) -> Column:
        total = F.size("found") + F.size(other)
        return F.when(total == 0, 1.0).otherwise(1 - F.coalesce(F.col(d), F.lit(0)) / total)

    return base.join(by_key, "key", "left").select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("found")).alias("fingerprint"), printed(F.col("edited_found")).alias("edited_fingerprint"),
        likeness("d0", "edited_found").alias("near_edited"), likeness("d1", "next_found").alias("near_next"))
