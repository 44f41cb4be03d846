"""Session settings and staged tables.

A staged table is an intermediate result that several later passes read.  It is
written as parquet under the shared folder named by ``spark.checkpoint.dir``:
the shuffle behind it runs once, later passes read only the columns they need,
and losing an executor never loses it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STAGE_PREFIX = "flowcascade-stage-"

_local_roots: dict[str, str] = {}


# Wide projections compile to long methods.  The JVM never compiles a method
# above 8000 bytes of bytecode, so beyond that Spark had better split the code.
RUNTIME_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> None:
    """Apply the runtime settings the wide expressions need to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)


def build_session(master: str | None = None, app: str = "flowcascade",
                  shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Adaptive execution coalesces small shuffle partitions and splits skewed
    ones, so ``shuffle_partitions`` only has to be large enough for the data.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "128m")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables.

    The session's ``spark.checkpoint.dir`` (or a checkpoint folder set in code)
    is used when there is one.  Without one, a local session gets a fresh
    temporary folder; a cluster session is refused, because a machine-local
    folder would not be visible to all executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    from_code = context.getCheckpointDir()
    if from_code:
        return from_code.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    key = context.applicationId
    if key not in _local_roots:
        _local_roots[key] = tempfile.mkdtemp(prefix="flowcascade-")
    return _local_roots[key]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{STAGE_PREFIX}{name}-{uuid.uuid4().hex}"


def side_session(spark: SparkSession) -> SparkSession:
    """A second session on the same context with the same settings."""
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            side.conf.set(key, value)
    return side


def stage(df: DataFrame, name: str, spark: SparkSession | None = None,
          by: str | None = None) -> DataFrame:
    """Write ``df`` as a staged table and return a reader of it (in ``spark``).

    With ``by`` the table has a folder per value of that column, and readers that filter on
    it list and open only those folders.  Rows are brought together by the column first;
    Spark splits a large value over several tasks and merges small ones.
    """
    spark = spark or df.sparkSession
    path = stage_path(spark, name)
    if by is None:
        df.write.parquet(path)
    else:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[
        "`" + c.replace("`", "``") + "`" for c in df.columns])


def restage(df: DataFrame, name: str) -> DataFrame:
    """Stage ``df`` and delete the staged table it was computed from."""
    table = stage(df, name)
    discard_stage(df)
    return table


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard_stage(df: DataFrame) -> None:
    """Delete the staged tables ``df`` reads; its other inputs are left alone."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        at = folder.find(f"/{STAGE_PREFIX}")        # partitioned tables have folders below
        if at >= 0:
            end = folder.find("/", at + 1)
            delete_folder(df.sparkSession, folder if end < 0 else folder[:end])
