"""Session settings and the shared folder that written intermediate tables use."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_SETTING = "spark.sql.shuffle.partitions"
ADVISORY_SETTING = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPLIT_SETTING = "spark.sql.files.maxPartitionBytes"
#: Rows of the largest table that one task of a shuffle gets, and the bytes up to which Spark may join small parts again.
ROWS_A_TASK = 250_000
ADVISED_BYTES = 8 << 20
#: Bytes of a file that one task reads, so that what it groups before a shuffle stays small too.
SPLIT_BYTES = 32 << 20


def local_session(app: str = "civicspan", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def tasks_for(rows: int) -> int:
    """In how many parts so many rows are dealt, so that a task's memory does not grow with them."""
    return max(1, math.ceil(rows / ROWS_A_TASK))


def fit_shuffles(spark: SparkSession, rows: int) -> None:
    """Have the session's next jobs deal so many rows to enough tasks; settings that already do so stay.

    Small parts are joined again by adaptive execution, so that jobs on less data lose little by it. However many partitions
    there are, it would join them up to the advised size, so rows for several tasks lower that too, and the size of splits."""
    needed = tasks_for(rows)
    if needed > int(spark.conf.get(SHUFFLE_SETTING)):
        spark.conf.set(SHUFFLE_SETTING, str(needed))
    if needed > 1:
        for setting, most in ((ADVISORY_SETTING, ADVISED_BYTES), (SPLIT_SETTING, SPLIT_BYTES)):
            present = spark.sql(f"SET {setting}").first()["value"]
            spark.conf.set(setting, str(min(_bytes(present), most)))


def _bytes(text: str) -> int:
    """A size as Spark's settings have it, such as 64MB or 16m; without a unit it is in bytes."""
    digits = text.rstrip("bBkKmMgGtT")
    unit = text[len(digits) :].lower()[:1]
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="civicspan-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and still there if an executor is lost."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
