"""Session, checkpoint and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dendrospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would lose data with the machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: tables that ``cut`` has written, oldest first
WRITTEN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    This drops the lineage, survives the loss of executors, and gives the planner
    the true size of the table. (The size estimate of a checkpointed frame is
    carried over from its plan; in a loop of joins it grows without bound.)
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder for a table that is written and read back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row from several one-row frames with different columns: a union and an aggregate, no join."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: sorted and merged, never broadcast.

    The planner goes by compressed bytes. 10 MB of written ids are two million rows, which take over 200 MB of the driver once they are broadcast.
    """
    return df.hint("merge")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
