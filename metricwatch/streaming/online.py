"""Online scoring against a stored profile, and keeping that profile current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricwatch.options import FunnelOptions
from metricwatch.plans import funnel, profile
from metricwatch.session import cut_lineage
from metricwatch.sources.alerts import alerted, forget_alerts, mark_alerted
from metricwatch.sources.store import PARTS, load_parts, parts_with, save_parts

TABLES = ("meta", "samples", "methods")


def save_profile(root: str, key: str, history: DataFrame, options: FunnelOptions, parts: int = PARTS) -> None:
    """Build a profile and store it with the threshold rule of each series."""
    meta, samples = profile.build_profile(history, options)
    save_parts(root, key, parts, meta=meta, samples=samples, methods=funnel.l1_methods(history))


def load_profile(spark: SparkSession, root: str, key: str, series: DataFrame | None = None, parts: int = PARTS) -> tuple[DataFrame, ...] | None:
    """`(meta, samples, methods)`: all, or what lies in the parts that hold one of the series."""
    return load_parts(spark, root, key, *TABLES, only=None if series is None else parts_with(series, parts))


def score_batch(batch: DataFrame, root: str, key: str, options: FunnelOptions, run: object = None, parts: int = PARTS) -> DataFrame:
    """Verdicts, bands and flags of a batch under the stored profile, with alerts shaped as the options say.

    Points of the batch that the profile already holds do not judge themselves. With `dedupe`, alerts
    raised by other runs within the lookback are not raised again.
    """
    points = batch.groupBy("series_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    meta, samples, methods = load_profile(batch.sparkSession, root, key, points, parts)
    past = profile.without_points(samples, points)
    scored = funnel.score(points, past.select("series_id", "ts", "value"), meta, past, methods, options)
    mode = options.effective_alert_mode
    if mode == "latest_only":
        scored = cut_lineage(scored)
    seen = alerted(batch.sparkSession, root, key, run, meta, options.lookback_secs) if mode == "dedupe" else None
    return funnel.shape_alerts(scored, mode, seen)


def learn_batch(scored: DataFrame, root: str, key: str, options: FunnelOptions, parts: int = PARTS) -> None:
    """Take a scored batch into the profile: upsert, evict, leave out anomalies, scrub; only parts with its series are read and written."""
    meta, samples, methods = load_profile(scored.sparkSession, root, key, scored, parts)
    moved, kept = profile.refresh_profile(
        meta, samples, scored.select("series_id", "ts", "value"), scored.where(F.col("anomaly") == 1).select("series_id", "ts"), options)
    # first to the checkpoint folder: the parts that are read are the ones replaced
    save_parts(root, key, parts, meta=cut_lineage(moved), samples=cut_lineage(kept))


def evaluate(current: DataFrame, history: DataFrame, root: str, key: str, run: object, options: FunnelOptions = FunnelOptions(), parts: int = PARTS) -> DataFrame:
    """One evaluation of a window with its state: the profile is made or read, alerts are marked, the window is learned.

    `current` and `history` have `series_id, ts, value`. The result is written to the checkpoint
    folder. Evaluations of overlapping windows count each point once; the same run may be repeated.
    """
    spark = current.sparkSession
    if load_profile(spark, root, key) is None:
        save_profile(root, key, history, options, parts)
    scored = cut_lineage(score_batch(current.withColumn("event_id", F.lit(0)), root, key, options, run, parts))
    mark_alerted(root, key, run, scored)
    learn_batch(scored, root, key, options, parts)
    return scored


def run_online(
    stream: DataFrame,
    root: str,
    key: str,
    output: str,
    checkpoint: str,
    options: FunnelOptions = FunnelOptions(),
    learn: bool = True,
    every: str | None = None,
    parts: int = PARTS,
) -> StreamingQuery:
    """Score every micro-batch, write it under its batch id, note its alerts, and take it into the profile.

    A batch that is run again overwrites its own output and alerts; upserts and scrubbing give the
    same profile again. The profile is read anew for each batch. `every` is a processing-time
    interval; without it the query ends when it has taken all there is.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            target, spark = f"{output}/batch={batch_id}", batch.sparkSession
            if batch.isEmpty():
                return
            score_batch(batch, root, key, options, batch_id, parts).write.mode("overwrite").parquet(target)
            scored = spark.read.parquet(target)
            mark_alerted(root, key, batch_id, scored)
            if learn:
                learn_batch(scored, root, key, options, parts)
            oldest = load_profile(spark, root, key)[0].agg(F.min("last_seen_ts")).first()[0]
            forget_alerts(spark, root, key, oldest - options.lookback_secs)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
