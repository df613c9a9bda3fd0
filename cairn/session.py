"""Session factory and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "cairn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Shuffle partition counts are left to adaptive execution on a cluster; pass
    ``**{"spark.sql.shuffle.partitions": "8"}`` for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only in local mode.

    The folder named by ``spark.checkpoint.dir`` always wins.  A machine-local folder would be
    lost with its executor, so a cluster session without the setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="cairn-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


#: Spark removes a query's shuffle files when the query ends, if this is set when its plan is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Reliable checkpoint: later stages restart from storage, not from the whole history.

    The shuffle files behind it are of no further use and are removed at once, not when the driver
    happens to collect its garbage.  With ``keep_partitioning`` later plans know by which columns the rows
    are dealt out, which adaptive execution does not tell: the step itself runs without it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    settings = {_CLEANUP: "true"} | ({"spark.sql.adaptive.enabled": "false"} if keep_partitioning else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return df.select("*").checkpoint(eager=True)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def forget(df: DataFrame) -> None:
    """Deletes the files of a result of ``cut_lineage`` that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
