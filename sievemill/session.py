"""Session helpers shared by the library: settings, tables and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "sievemill", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it; on a cluster it is deployed as usual."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "sievemill-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[str] = []


def _on_files(spark: SparkSession, path: str, act: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(target) if act == "later" else files.delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut of the lineage that survives lost executors.

    What is written is deleted when the application ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    _on_files(spark, path, "later")
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediates written so far; frames that still read them become invalid. Returns how many there were."""
    n = len(_written)
    while _written:
        _on_files(spark, _written.pop(), "now")
    return n


def latest_delivery(df: DataFrame, key: str) -> DataFrame:
    """One row per key; redelivered rows have the same content, so any one of them stands for the key."""
    return df.dropDuplicates([key])


def md5_order(seed: int, *cols) -> F.Column:
    """A pseudo-random order that any engine can reproduce: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
