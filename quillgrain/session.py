"""Session settings the engine expects, for tests, the benchmark and local use."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillgrain", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC timestamps, adaptive execution and Arrow transfer.

    On a cluster the session comes from the launcher; nothing here is required beyond UTC.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where it is unset, as in local tests, a folder of this process is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillgrain-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as reliably checkpointed data in the shared folder, so a lost executor costs nothing upstream."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: compressed, prunable, reread without recomputing."""
    import uuid

    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillgrain-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
