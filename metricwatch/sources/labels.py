"""Labelled metric files, label windows, and the export of labelled history and current parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import rolling, row_index, running_sum

STRETCH = 86_400


def _series_name(raw: DataFrame, series: str | None) -> Column:
    if series:
        return F.lit(series)
    return F.col("series_id").cast("string") if "series_id" in raw.columns else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)


def write_labelled_csv(labelled: DataFrame, path: str) -> None:
    """Files `timestamp_ms,value,is_anomaly` in a folder per series, as `read_labelled_csv` takes them."""
    rows = labelled.select("series_id", (F.col("ts") * 1000).alias("timestamp_ms"), "value", F.col("label").alias("is_anomaly"))
    # a long series is shared by several files
    spread = F.pmod(F.xxhash64("timestamp_ms"), F.lit(8))
    rows.repartition("series_id", spread).sortWithinPartitions("series_id", "timestamp_ms").write.partitionBy("series_id").option("header", True).csv(path)


def read_labelled_csv(spark: SparkSession, path: str, series: str | None = None) -> DataFrame:
    """`series_id, ts, value, label` of files with a header `timestamp_ms|timestamp_s,value,is_anomaly`.

    The unit comes from the name of the time column; a label of at least 0.5 counts. A series is named
    by `series`, else by its folder (`series_id=...`), else by its file.
    """
    raw = spark.read.csv(path, header=True)
    time = next((c for c in raw.columns if c.lower().startswith("timestamp")), raw.columns[0])
    value, label = [c for c in raw.columns if c not in (time, "series_id")][:2]
    seconds = F.col(time).try_cast("double")
    if time.lower().endswith("_ms"):
        seconds = seconds / 1000.0
    name = _series_name(raw, series)
    return raw.select(
        name.alias("series_id"), F.floor(seconds).cast("long").alias("ts"),
        F.col(value).try_cast("double").alias("value"),
        (F.trim(F.col(label)).try_cast("double") >= 0.5).cast("int").alias("label"),
    )


def read_raw_csv(spark: SparkSession, path: str, series: str | None = None) -> DataFrame:
    """Points of files with a header `timestamp,value`; rows that do not parse are left out."""
    raw = spark.read.csv(path, header=True)
    time = F.try_to_timestamp(F.trim("timestamp"), F.lit("yyyy-MM-dd HH:mm:ss"))
    name = _series_name(raw, series)
    return raw.select(
        name.alias("series_id"), F.unix_seconds(time).alias("ts"), F.col("value").try_cast("double").alias("value")
    ).na.drop()


def merged_windows(windows: DataFrame) -> DataFrame:
    """Closed windows `series_id, start_ts, end_ts` with those that touch or overlap made one.

    A window opens a new stretch where it starts behind the largest end of all windows before it.
    Windows without both ends, or that end before they start, hold nothing.
    """
    known = windows.where(F.col("start_ts") <= F.col("end_ts")).select("series_id", F.col("start_ts").cast("long").alias("start_ts"), F.col("end_ts").cast("long").alias("end_ts"))
    before = Window.partitionBy("series_id").orderBy("start_ts", "end_ts").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start_ts") > F.max("end_ts").over(before) + 1, F.lit(True)).cast("int")
    numbered = known.withColumn("_opens", opens).withColumn("_stretch", F.sum("_opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("series_id", "_stretch").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")).drop("_stretch")


def label_by_windows(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Add `label`: 1 inside any closed window `series_id, start_ts, end_ts`.

    Overlapping windows are merged first. Each stretch of time (a day) then knows, per series, the
    windows inside it in order, disjoint; a point meets the one that starts last before it, by a
    running maximum over windows and points of its stretch. So a point never meets more than one
    window, and a long window is one row a day.
    """
    day = lambda ts: F.floor(F.col(ts) / STRETCH)
    pieces = merged_windows(windows).withColumn("_day", F.explode(F.sequence(day("start_ts"), day("end_ts")))).select(
        "series_id", "_day", F.greatest("start_ts", F.col("_day") * STRETCH).alias("ts"), F.struct("start_ts", "end_ts").alias("_window"))
    both = points.withColumn("_day", day("ts")).withColumn("_point", F.lit(1)).unionByName(pieces.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    # points are unique by second, so a stretch holds at most a day of them and its windows
    upto = Window.partitionBy("series_id", "_day").orderBy("ts", "_point").rowsBetween(Window.unboundedPreceding, 0)
    met = F.max("_window").over(upto)
    label = F.coalesce((F.col("ts") <= met["end_ts"]).cast("int"), F.lit(0))
    return both.withColumn("label", label).where("_point = 1").select(*points.columns, "label")


def label_by_points(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Add `label`: 1 at exactly the marked times."""
    known = marks.select("series_id", "ts", F.lit(1).alias("label")).distinct()
    return points.join(known, ["series_id", "ts"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def anomaly_clusters(labelled: DataFrame, gap_rows: int) -> DataFrame:
    """`series_id, cluster, first_rn, last_rn`: labelled rows no more than `gap_rows` positions apart."""
    marked = row_index(labelled.where(F.col("label") == 1), out="mark")
    steps = rolling(marked, {"_gap": lambda w: F.col("rn") - F.lag("rn").over(w)}, back=1, index="mark")
    opened = steps.withColumn("_new", F.coalesce((F.col("_gap") > gap_rows).cast("long"), F.lit(0)))
    numbered = running_sum(opened, {"cluster": "_new"}, index="mark")
    return numbered.groupBy("series_id", "cluster").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


def split_around_cluster(labelled: DataFrame, current_rows: int, cluster: int = 0) -> DataFrame:
    """Add `role`: current is the chosen anomaly cluster with half a window on each side, history
    what lies before it. Without anomalies the last `current_rows` rows are current."""
    indexed = row_index(labelled, total="n")
    clusters = anomaly_clusters(indexed, current_rows)
    last = clusters.groupBy("series_id").agg(F.max("cluster").alias("_max"))
    chosen = clusters.join(last, "series_id").where(F.col("cluster") == F.least(F.lit(cluster), F.col("_max")))
    wide = attach(indexed, chosen.select("series_id", "first_rn", "last_rn"))
    half = current_rows // 2
    found = F.col("first_rn").isNotNull()  # greatest and least pass over NULLs
    tail = F.greatest(F.col("n") - current_rows, F.lit(0))
    start = F.when(found, F.greatest(F.col("first_rn") - half, F.lit(0))).otherwise(tail)
    end = F.when(found, F.least(F.col("last_rn") + half + 1, F.col("n"))).otherwise(F.col("n"))
    role = F.when(F.col("rn") < start, "history").when(F.col("rn") < end, "current")
    return wide.withColumn("role", role).where(F.col("role").isNotNull()).drop("first_rn", "last_rn", "rn", "n")


def incidents(flagged: DataFrame, gap_secs: int) -> DataFrame:
    """Runs of anomalies no more than `gap_secs` apart: start, end, count and worst value."""
    marked = row_index(flagged.where(F.col("anomaly") == 1), out="mark")
    steps = rolling(marked, {"_gap": lambda w: F.col("ts") - F.lag("ts").over(w)}, back=1, index="mark")
    opened = steps.withColumn("_new", F.coalesce((F.col("_gap") > gap_secs).cast("long"), F.lit(0)))
    return running_sum(opened, {"incident": "_new"}, index="mark").groupBy("series_id", "incident").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("points"),
        F.max("value").alias("peak"),
    )
