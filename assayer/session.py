"""Session settings the operators rely on, and the checkpoint folder they cut lineage into."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables that ``cut`` wrote, by application, in order.
_cuts: dict[str, list[str]] = {}


def local_session(cpus: int | str = "*", app: str = "assayer", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that one job writes and another reads."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the checkpoint folder, so that a lost executor replays nothing before it.

    The copy stays until the ``scope`` around it ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    if path := cut_folder(done._jdf.queryExecution().logical()):
        _cuts.setdefault(spark.sparkContext.applicationId, []).append(path)
    return done


#: Rows of one task of a settled table, and the bytes of files for each core from which a table is read as it is.
TASK_ROWS, CORE_BYTES = 100_000, 128 << 20


def settled(df: DataFrame) -> DataFrame:
    """``df`` cut with its rows dealt evenly to tasks of TASK_ROWS, for operators that scan a table many times.

    A small file of many rows is one task otherwise, with all the work on them.  Tables whose files give every core
    CORE_BYTES to read come back as they are, and so do settled ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if getattr(df, "_assayer_settled", False) or not df.columns or input_bytes(df) >= cores * CORE_BYTES:
        return df
    parts = max(cores, -(-df.count() // TASK_ROWS))
    numbered = df.withColumn("__dealt", F.monotonically_increasing_id())  # a plain repartition sorts the rows of a task first
    out = cut(numbered.repartition(parts, "__dealt").drop("__dealt"))
    out._assayer_settled = True
    return out


def cut_folder(leaf) -> str | None:
    """The checkpoint folder that a leaf of a plan reads, None for other leaves."""
    if leaf.getClass().getSimpleName() != "LogicalRDD":
        return None
    path = leaf.rdd().getCheckpointFile()
    return path.get() if path.isDefined() else None


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was cut inside; results that build on it must have been written by then.  Scopes may be nested."""
    own = _cuts.setdefault(spark.sparkContext.applicationId, [])
    first = len(own)
    try:
        yield
    finally:
        for path in own[first:]:
            at, files = _files(spark, path)
            files.delete(at, True)
        del own[first:]


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, cut tables included, as its plan knows them without a job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if path := cut_folder(leaf):
            at, files = _files(df.sparkSession, path)
            total += files.getContentSummary(at).getLength()
        elif leaf.getClass().getSimpleName() != "LogicalRDD":  # a table made from rows has no known size
            total += int(str(leaf.stats().sizeInBytes()))
    return total
