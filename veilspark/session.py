"""Session helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", checkpoints: str | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use; ``checkpoints`` is where lineage is cut."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config("spark.checkpoint.dir", checkpoints) if checkpoints else builder).getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of the data folder, pruned to ``columns`` when any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy Python stage at least one input partition per core.

    A table of one small file would run on one core. Where the scan already has as many partitions as the
    cluster has cores nothing is added, so large inputs keep their zero-exchange plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``.

    Only a local session may go without that setting and gets a folder of its own; elsewhere executors would write to their own
    disks, so an unset folder is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[[\d*,]+\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="veilspark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
