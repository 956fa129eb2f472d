from metricwatch.catalog import ensemble, results, streams
from metricwatch.options import ForecastOptions, FunnelOptions, OutlierOptions


def test_registered_queries_use_the_default_sizes(monkeypatch):
    seen = []
    for module in (ensemble, results, streams):
        for name in ("pts", "row_index", "history", "current", "scratch", "save_tables", "load_tables", "model_key"):
            monkeypatch.setattr(module, name, lambda *a, **k: None, raising=False)
    take = lambda *a, **k: seen.extend(x for x in a if isinstance(x, (ForecastOptions, FunnelOptions, OutlierOptions)))
    monkeypatch.setattr(ensemble, "detect_outliers", take)
    monkeypatch.setattr(ensemble.forest, "forest_scores", take)
    monkeypatch.setattr(streams.forest, "fit_forest", lambda rows, options: take(options) or (None, None))
    monkeypatch.setattr(results.forecast, "detect_forecast", take)
    monkeypatch.setattr(results.funnel, "detect_funnel", take)
    for query in (ensemble.isolation_forest, ensemble.outlier_full, streams.stored_forest_scores, results.forecast_detector, results.funnel_two_levels):
        query(None, "")
    trees = [o.n_trees for o in seen if isinstance(o, OutlierOptions)]
    assert trees == [OutlierOptions().n_trees] * 4
    boosted = [o for o in seen if isinstance(o, ForecastOptions)]
    assert [(o.iterations, o.max_depth) for o in boosted] == [(ForecastOptions().iterations, ForecastOptions().max_depth)]
    assert [o.forecast_iterations for o in seen if isinstance(o, FunnelOptions)] == [FunnelOptions().forecast_iterations]
