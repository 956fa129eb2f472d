"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that only change how plans run, never what they return.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",  # 10,000 long texts at once take several times their size on both sides
}


def local_session(app: str = "metricwatch", cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the given session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("METRICWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The archive is made on the driver and served by Spark, so workers need no installed copy. A
    package that was itself shipped or installed as an archive is left alone.
    """
    package, context = Path(__file__).resolve().parent, spark.sparkContext
    if getattr(context, "_metricwatch_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="metricwatch-")) / "metricwatch.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._metricwatch_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created, and send it the package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A session that names none gets a temporary folder in local mode only; on a cluster the executors
    would each write to a disk of their own, so that is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="metricwatch-checkpoint-")
    context.setCheckpointDir(folder)
    own = context._jsc.sc().getCheckpointDir().get()  # a new folder below the named one
    delete_at_end(spark, own)
    return own


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Have a folder, made if need be, deleted when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`cut_lineage` for long tables: as Parquet, computed once, with columns that can be pruned."""
    path = table_path(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def delete_written(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
