"""Values that tie with a band, and points of one second."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from oracle_check import compare, connect

import __spark_entry__ as entry


def write_events(folder, rows):
    """`rows` of (time, type, value), numbered in their order."""
    at, kinds, values = zip(*rows)
    pq.write_table(pa.table({
        "event_id": list(range(len(rows))), "ts": pa.array(at, pa.timestamp("us")), "user_id": [1] * len(rows),
        "event_type": list(kinds), "value": [float(v) for v in values], "props": ["{}"] * len(rows)}), f"{folder}/events.parquet")


def check(spark, folder, name):
    line, ok = compare(spark, connect(str(folder)), name, entry.queries()[name], entry.oracle_sql()[name], str(folder))
    assert ok, line


def test_rolling_flags_of_values_on_the_band(spark, tmp_path):
    """Five values, then one that lies on their band to the cent."""
    rng, start, cents = random.Random(7), datetime(2024, 1, 1), []
    for i in range(2_000):
        q1, mid, q3 = sorted(rng.randrange(3_000, 9_000) for _ in range(3))
        far = rng.randrange(1, 100)
        five = [q1 - 25 * far, q1, mid, q3, q3 + 25 * far]
        edge = five[0] + far - 2 * (q3 - q1) if i % 2 else five[4] - far + 2 * (q3 - q1)
        cents += [*five, edge]
    write_events(tmp_path, [(start + timedelta(seconds=i), "a", c / 100) for i, c in enumerate(cents)])
    check(spark, tmp_path, "rolling_iqr_flags")


def test_written_points_of_one_second_are_in_order(spark, tmp_path):
    start = datetime(2024, 1, 20)
    rows = [(start + timedelta(minutes=10 * i, milliseconds=m), "a", i % 5 + m / 1000) for i in range(1_000) for m in (0, 400)]
    write_events(tmp_path, rows)
    check(spark, tmp_path, "written_results")
