"""Session helpers: nothing here overrides what the cluster has already set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("statloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only where the session names none (local tests) is a folder of our own chosen.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="statloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written yet, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(spark: SparkSession, path: str, column: str, mark: str = "") -> list[int]:
    """The numbers n of the folders `column`=n below a path, by listing; with a mark, only folders that hold that file."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}=*" + (f"/{mark}" if mark else ""))
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    folders = [status.getPath().getParent() if mark else status.getPath() for status in found]
    values = [folder.getName().partition("=")[2] for folder in folders]
    return sorted(int(v) for v in values if v.isdigit())


def make_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table that is read more than once to the shared folder.

    Cuts the lineage like a checkpoint, but columnar and with sizes the planner can use.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
