"""Result tables as they are shown: series names, display times, anomaly points only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = r"\{\{([^{}]*)\}\}"
BANDS = ("lower_bound", "upper_bound")


def interpolate_label(template: Column, labels: Column) -> Column:
    """Fill `{{name}}` placeholders from a label map; unknown names become empty.

    Without labels the template stays as it is.
    """
    # Pieces alternate between text and placeholder name, so a filled value is never filled again.
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    texts = F.split(template, PLACEHOLDER)
    filled = F.transform(names, lambda n: F.coalesce(F.element_at(labels, n), F.lit("")))
    rest = F.zip_with(filled, F.slice(texts, F.lit(2), F.size(texts)), lambda v, t: F.concat(v, F.coalesce(t, F.lit(""))))
    out = F.concat(F.element_at(texts, 1), F.array_join(rest, ""))
    return F.when(labels.isNull() | (F.size(labels) == 0), template).otherwise(out)


def label_name(labels: Column) -> Column:
    """`{a="1", b="2"}` from a label map, sorted by name; empty without labels."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
    )
    return F.when(labels.isNull() | (F.size(labels) == 0), F.lit("")).otherwise(
        F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    )


def series_name(frame_name: Column, template: Column, labels: Column) -> Column:
    """The user's template if there is one, else the frame's name, else its labels."""
    return (
        F.when(F.trim(F.coalesce(template, F.lit(""))) != "", interpolate_label(template, labels))
        .when(F.trim(F.coalesce(frame_name, F.lit(""))) == "", label_name(labels)).otherwise(frame_name)
    )


def column_name(ref: str, series: Column, column: str) -> Column:
    return F.concat(F.lit(f"{ref}-"), series, F.lit(f"-{column}"))


def anomaly_value(flag: Column = None, value: Column = None) -> Column:
    """The value of a flagged point, else NULL."""
    flag = F.col("anomaly") if flag is None else flag
    value = F.col("value") if value is None else value
    return F.when(flag == 1, value)


def result_frame(result: DataFrame, method: str, anomalies_only: bool = False) -> DataFrame:
    """Columns a method shows: outliers time and anomaly, the others their line and band too."""
    shown = result.withColumn("time", F.timestamp_seconds("ts")).withColumn("anomaly_value", anomaly_value())
    if method == "outlier" or anomalies_only:
        return shown.select("series_id", "time", "anomaly_value")
    line = {"baseline": "baseline", "forecast": "pred"}[method]
    return shown.select("series_id", "time", F.col("baseline").alias(line), *BANDS, "anomaly_value")


def anomaly_points(result: DataFrame) -> DataFrame:
    """Only the flagged points."""
    return result.where(F.col("anomaly") == 1).select("series_id", "ts", anomaly_value().alias("anomaly_value"))


def write_results(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as Parquet, clustered by series so that readers of one series skip the rest."""
    result.repartitionByRange("series_id", "ts").sortWithinPartitions("series_id", "ts").write.mode(mode).parquet(path)
