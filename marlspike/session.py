"""Session helpers: table access, durable lineage cuts and shuffle sizing."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder named in ``spark.checkpoint.dir``.

    Only a session on one machine that names none (tests, notebooks) gets a folder of its own; on a cluster a
    folder of the driver would not be the executors', so a missing setting is refused there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlspike-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The files outlive any executor, so a lost one never forces a recomputation of the plan above.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the checkpoint files of ``frames`` from ``cut``, once everything that reads them is materialised."""
    for df in frames:
        rdd = df._jdf.queryExecution().analyzed().rdd()
        at = rdd.getCheckpointFile()
        if at.isDefined():
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of sort-merge joins only.

    The planner counts an array as one element and an exploded row as one row, so behind generators, Python
    stages and checkpoints its size estimate can be far too small to choose a broadcast by.
    """
    return df.hint("merge")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, at least the cores it can use."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with repeated rows counted once.

    Only if a key occurs twice, which one aggregation of keys tells, are the rows themselves compared; a table of
    unique keys is not shuffled.
    """
    return df if df.groupBy(key).count().where("count > 1").isEmpty() else df.distinct()


def settled(c: Column) -> Column:
    """``c`` computed once per row, whatever reads it later.

    The optimizer merges neighbouring projections and would repeat a long expression at every use; a generator of
    one element stands between them.
    """
    return F.explode(F.array(c))


def spread(df: DataFrame) -> DataFrame:
    """A scan over the session's cores where its files give fewer partitions than that.

    Only inputs of a few splits are repartitioned, so what moves is at most a split per core.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    Workers started in another folder or on another machine don't share the driver's module path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="marlspike-package-"), "marlspike.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("marlspike", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
