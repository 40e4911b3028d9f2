"""Pieces shared by the corpus operators: the shared folder, lineage cuts, null-safe row removal."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in the contracts: blank and the five ASCII line and tab characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and Spark runs on this machine alone (tests, a laptop) a folder of this process is made and set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="gridlake-")
        atexit.register(shutil.rmtree, own, True)
        folder = "file://" + own
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in a folder of the shared one that goes when the application ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/gridlake-{context.applicationId}"
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not store.exists(at):
        store.mkdirs(at)
        store.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffles and checkpoints that no live DataFrame refers to any more.

    Spark deletes their files once the driver's JVM has collected what refers to them, which in a long query with few
    objects may not happen by itself; so it is asked to collect.
    """
    gc.collect()  # Python's handles first
    spark.sparkContext._jvm.System.gc()


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``frame`` has it in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """A column by its literal name (dots and backticks in it are no syntax)."""
    return F.col("`" + name.replace("`", "``") + "`")


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of several column pairs, as a join condition."""
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))


def without_rows(docs: DataFrame, keys: dict[str, Column], dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``keys`` stand in ``dropped``; of rows with equal keys one stays.

    ``keys`` names expressions over ``docs`` that tell its rows apart (an id and a digest of the text), ``dropped``
    has columns of those names. Keys compare null-safe. The anti join and the window use one partitioning.
    """
    names = {k: free_name(docs, k) for k in keys}
    keyed = docs.withColumns({names[k]: e for k, e in keys.items()})
    away = dropped.select(*[F.col(k).alias(f"away_{k}") for k in keys])
    left = keyed.join(away, same(keyed, away, [(names[k], f"away_{k}") for k in keys]), "left_anti")
    rank = free_name(docs, "row_rank")
    order = Window.partitionBy(*[col(n) for n in names.values()]).orderBy(F.lit(0))
    ranked = left.withColumn(rank, F.row_number().over(order)).where(col(rank) == 1)
    return ranked.select(*[col(c) for c in docs.columns])
