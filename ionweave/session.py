"""Session helpers: reading tables, the shared folder for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Keys that hold more than this share of the rows are treated as hot; there can be at most its inverse of them.
HOT_SHARE = 1e-3


def local_session(cores: int = 8, shuffle: int = 8, memory: str = "6g", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below the one that all executors share, ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is taken on a local master; on a cluster, where each machine would have
    its own, that is refused. The folder is deleted when the application ends, or by ``forget``.
    """
    named = spark.conf.get("ionweave.shared.dir", None)
    if not named:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ionweave-")
            spark.sparkContext.setCheckpointDir(base)
        named = f"{base.rstrip('/')}/ionweave-{spark.sparkContext.applicationId}"
        spark.conf.set("ionweave.shared.dir", named)
        atexit.register(forget, spark)
    return named


def forget(spark: SparkSession) -> None:
    """Deletes all tables that ``materialise`` has written for this application; what was built on them cannot be read any more."""
    try:
        named = spark.conf.get("ionweave.shared.dir", None)
        if named:
            path = spark._jvm.org.apache.hadoop.fs.Path(named)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            spark.conf.unset("ionweave.shared.dir")
    except Exception:  # the session has ended: the folder stays for whoever cleans the shared one
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut and every later use reads files.

    Unlike a local checkpoint the files survive the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
