"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridmosaic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    Used where a later step depends on the physical split of the rows, so a
    recomputed partition must not come out differently. The folder is the one
    the cluster names; only a local session without one gets a scratch folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get(CHECKPOINT_CONF, None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="gridmosaic-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
