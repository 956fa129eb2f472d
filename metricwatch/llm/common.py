"""What the text operators share: column idioms, stored tables, id filters."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.session import checkpoint_dir, delete_at_end

SPACE = r"[\x20\x09-\x0D]"
BROADCAST_IDS = 1_000_000  # ids of eight bytes: the most that a filter by id sends to every executor


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also where lambdas inside `body` use it per element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; only these are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def shared_path(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder; what is there goes when the application ends."""
    base = f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    delete_at_end(spark, base)
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared checkpoint folder and read them back.

    Cuts the lineage (a lost executor costs no recomputation) and keeps columns prunable.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and have Spark drop the shuffle files of finished jobs.

    Spark removes shuffle files when the driver's garbage is collected, by default every half hour;
    asking for it between the steps of a long operator keeps the disk to what the next step needs.
    """
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def by_ids(docs: DataFrame, ids: DataFrame, how: str, id_column: str = "doc_id") -> DataFrame:
    """Semi or anti join of whole documents with a stored table of ids in its first column.

    Up to BROADCAST_IDS counted ids go to every executor and the texts stay where they are; beyond
    that both sides are shuffled. Rows without an id match nothing.
    """
    key = "__by_id"
    right = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    if ids.count() <= BROADCAST_IDS:
        right = F.broadcast(right)
    return docs.join(right, docs[id_column] == F.col(key), how)
