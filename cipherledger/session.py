"""Session helpers and durable stage boundaries."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app_name: str = "cipherledger") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]").appName(app_name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Settings the wide rule chains need, applied where the session leaves defaults.

    A generated method above 8000 bytecodes is never compiled by the JVM, so a stage that
    large runs several times faster through split projections than fused and interpreted.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # A scan runs many jobs; the shuffle files of one go when it ends, not with the session.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


_LOCAL: dict[str, str] = {}
_STAGES: dict[str, SparkSession] = {}


def stage_directory(spark: SparkSession) -> str:
    """The shared folder for stage tables: ``spark.checkpoint.dir`` of the session. A local
    session without it gets one temporary folder per application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def write_stage(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write a stage table and read it back; ``options`` go to the writer.

    Used where a table feeds many later joins or an iteration: it cuts the lineage,
    survives lost executors, lets every reader prune columns, and gives the optimizer
    real sizes. ``drop_stage`` removes it; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = stage_folder(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new path for files that tasks write themselves; it goes when the driver ends."""
    path = f"{stage_directory(spark)}/stage-{name}-{uuid.uuid4().hex}"
    _STAGES[path] = spark
    return path


def drop_stage(*tables: DataFrame) -> None:
    """Remove stage tables that nothing reads any more."""
    for path in [getattr(t, "stage_path", None) for t in tables]:
        if path in _STAGES:
            _remove(_STAGES.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    while _STAGES:
        path, spark = _STAGES.popitem()
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone; its folder is cleared with it
            return
