"""Session helpers: table access and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one is made only for a local master that names none; on a cluster
    such a folder could not be read by the executors, so that is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-checkpoint-"))
    return jsc.getCheckpointDir().get()


#: Tables this process has written, in order.
_written: list[str] = []


def clear_tables(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``materialize`` wrote in this process, from the ``since``-th on; returns how many.

    For when the results that stand on them are saved: a DataFrame read from a deleted table fails. A run that
    begins with ``mark = tables_written()`` and ends with ``clear_tables(spark, mark)`` leaves nothing behind.
    """
    gone = _written[since:]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    del _written[since:]
    return len(gone)


def tables_written() -> int:
    return len(_written)


def materialize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` once below the checkpoint folder and read it back.

    The written table survives lost executors, keeps its schema and can be read with column
    pruning and pushed filters, which a checkpointed RDD cannot.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/kinweave-{uuid.uuid4().hex}"
    _written.append(path)
    (df.select(*columns) if columns else df).write.parquet(path)
    return spark.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
