"""Session helpers: the shared folder, written intermediate tables, and the workers' import path."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_spark(app: str = "siltmill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that is there."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    use_repo(spark)
    return spark


def use_repo(spark: SparkSession) -> None:
    """Let Python workers import this package even when only the driver's sys.path has it."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which the cluster names.

    Where it is unset and the master is local, a temporary folder is made and recorded in the session.
    On a cluster an unset folder is an error, as a machine-local one would lose data with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame as Parquet into the shared folder and read it again.

    Executors may be lost afterwards; the files stay. The plan above is computed once only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path  # type: ignore[attr-defined]
    _tables.append(back)
    return back


#: What written() made and nothing has deleted.
_tables: list[DataFrame] = []


def discard_all() -> None:
    """Delete all tables that written() made in this process, at the end of a run."""
    while _tables:
        discard(_tables[-1])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has few splits; a file of one row group would else be one task's work.

    Large inputs have more splits than cores and aren't shuffled, and neither is what was shuffled before. Select the
    columns that are needed first."""
    ran = df._jdf.queryExecution()
    if ran.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if ran.toRdd().getNumPartitions() < 2 * cores else df


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by written(), once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    _tables[:] = [t for t in _tables if t is not df]
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
