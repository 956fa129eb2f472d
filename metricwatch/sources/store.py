"""Saved profiles and models as Parquet tables under a key.

Models are small and written whole, in versions. A profile is dealt to parts by a hash of the
series; taking in a batch rewrites the parts of the batch's series and leaves the others alone.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def model_key(options: object, series: str = "") -> str:
    """A key from the options that shaped a model."""
    body = asdict(options) if is_dataclass(options) else options
    return hashlib.sha256(json.dumps([body, series], sort_keys=True, default=str).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def names_below(spark: SparkSession, path: str, start: str = "") -> list[str]:
    """Names in a folder that begin with `start`; none if the folder does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return sorted(n for s in fs.listStatus(jpath) if (n := s.getPath().getName()).startswith(start))


def _current(spark: SparkSession, root: str, key: str) -> int:
    """Newest complete version under the key, -1 if there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    found = [int(n[2:]) for n in names if n.startswith("v=") and exists(spark, f"{root}/{key}/{n}/DONE")]
    return max(found, default=-1)


def save_tables(root: str, key: str, keep: int = 3, **tables: DataFrame) -> int:
    """Write a new version of the named tables; readers see it once all are complete.

    The version being read is never overwritten, so a table may depend on its predecessor.
    The newest `keep` versions stay.
    """
    spark = next(iter(tables.values())).sparkSession
    version = _current(spark, root, key) + 1
    base = f"{root}/{key}/v={version}"
    for name, table in tables.items():
        table.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("overwrite").parquet(f"{base}/{name}")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/DONE")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
    if version >= keep:
        delete_tables(spark, f"{root}/{key}", f"v={version - keep}")
    return version


def load_tables(spark: SparkSession, root: str, key: str, *names: str) -> tuple[DataFrame, ...] | None:
    """The newest complete version of the named tables, None if there is none."""
    version = _current(spark, root, key)
    if version < 0:
        return None
    out = []
    for name in names:
        table = spark.read.parquet(f"{root}/{key}/v={version}/{name}")
        if "format_version" in table.columns:  # tables written before versions existed have none
            table = table.drop("format_version")
        out.append(table)
    return tuple(out)


def delete_tables(spark: SparkSession, root: str, key: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


PARTS = 256  # of a profile; a batch rewrites those that hold one of its series
FILES = 4  # tasks that write one part


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("series_id"), F.lit(parts)).cast("int")


def save_parts(root: str, key: str, parts: int = PARTS, **tables: DataFrame) -> None:
    """Write tables with a `series_id` by parts; parts that none of the rows belong to stay as they are.

    Writing the same rows again gives the same table, so a step that failed half-way is run again.
    """
    for name, table in tables.items():
        spread = F.pmod(F.xxhash64(*[c for c in ("series_id", "ts") if c in table.columns]), F.lit(FILES))
        rows = table.withColumn("part", part_of(parts)).withColumn("_file", spread).repartition("part", "_file").drop("_file")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{root}/{key}/{name}")


def parts_with(series: DataFrame, parts: int = PARTS) -> list[int]:
    """The parts that hold a series of the table: at most `parts` numbers."""
    return sorted(r[0] for r in series.select(part_of(parts)).distinct().collect())


def load_parts(spark: SparkSession, root: str, key: str, *names: str, only: list[int] | None = None) -> tuple[DataFrame, ...] | None:
    """The named tables, or only the given parts of them; None if one was never written."""
    if not all(names_below(spark, f"{root}/{key}/{name}", "part=") for name in names):
        return None
    tables = [spark.read.parquet(f"{root}/{key}/{name}") for name in names]
    return tuple((t if only is None else t.where(F.col("part").isin(only))).drop("part") for t in tables)
