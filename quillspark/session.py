"""Session settings and checkpoints that outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.config(map=SETTINGS | conf)
    return (b.master(master) if master else b).getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="quill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by checkpoint(), in the shared folder."""
    _shared_dir(df.sparkSession)
    return df.checkpoint()


#: Scratch tables of this process.
_stored: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed scratch table in the shared folder, until the session ends; its shuffle files go as soon as it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, was = f"{_shared_dir(spark)}/stored-{uuid.uuid4().hex}", spark.conf.get(name, "false")
    _stored.append((spark, path))
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, was)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_stored() -> None:
    while _stored:
        spark, path = _stored.pop()
        try:
            to = spark._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
        except Exception:  # noqa: BLE001  the JVM has gone; its folder is the cluster's to clean
            return
