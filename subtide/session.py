"""Session helpers shared by the operators: the session itself, reading tables, cutting lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, AQE, a shuffle as wide as the cores."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(master).appName("subtide").config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset a local master (tests, a laptop) gets a local folder, once for the session; on a
    cluster that is an error, since each machine would have its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="subtide-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/subtide-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back: a cut in the lineage that any executor can read."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint in the shared folder; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it Arrow batches hold at most ``size`` bytes: for actions on rows that hold whole texts or sets. The setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)
