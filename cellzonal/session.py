"""Session for local runs, and the shared folder that durable results go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "cellzonal", **conf: str) -> SparkSession:
    """One-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees: the session's checkpoint folder.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="cellzonal-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """The table computed once and kept in the shared folder, for several readers."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The table written to the shared folder as Parquet, so that plans know its size."""
    path = f"{shared_folder(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsized(df: DataFrame) -> DataFrame:
    """The same rows under a size that the planner doesn't know, so that only measured ones are broadcast.

    Spark's estimates leave out how far ``explode`` grows a table: the cells of a small table of
    zones would go to the driver whatever their number. A join now waits for
    the shuffle of this side to tell its size, and broadcasts what is small indeed.
    """
    spark = df.sparkSession
    return df.union(spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema))
