import numpy as np

from metricwatch.options import OutlierOptions
from metricwatch.plans import outlier


def test_full_detector_reads_written_rows(points, monkeypatch):
    """Rounds start from a table that is written down, not from the points' own plan, and flags stay whole."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 300)
    v[150:] += 9
    seen, find = [], outlier.auto_decompose
    monkeypatch.setattr(outlier, "auto_decompose", lambda rows: seen.append(rows) or find(rows))
    rows = points([("s", 60 * i, x) for i, x in enumerate(v)] + [("flat", 60 * i, 1.0) for i in range(40)])
    found = outlier.detect_outliers(rows, OutlierOptions(detect_mode="full", n_trees=5)).collect()
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert len(found) == 340 and {r.ts for r in found if r.series_id == "s" and r.anomaly} >= {60 * 150}
    assert not any(r.anomaly for r in found if r.series_id == "flat")
