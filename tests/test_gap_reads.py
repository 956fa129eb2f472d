from metricwatch.operators import prepare

START, END = 100, 200


def rows_of(df):
    return sorted(tuple(r) for r in df.select("series_id", "ts", "value").collect())


def brute(stored, source, names):
    """Per series: its own stored points, and source points outside the stored range."""
    out = []
    for name in names:
        mine = [t for s, t, _ in stored if s == name]
        lo, hi = (min(mine), max(mine) + 1) if mine else (None, None)
        apart = lo is None or END <= lo or START >= hi
        out += [p for p in stored if p[0] == name and START <= p[1] < END]
        out += [p for p in source if p[0] == name and START <= p[1] < END and (apart or p[1] < lo or p[1] >= hi)]
    return sorted(out)


STORED = [(s, t, -1.0) for s, a, b in (("mid", 130, 150), ("left", 90, 120), ("right", 180, 230), ("all", 50, 250), ("before", 10, 40), ("after", 300, 340))
          for t in range(a, b, 3)]
SOURCE = [(s, t, float(t)) for s in ("mid", "left", "right", "all", "before", "after", "new") for t in range(0, 360, 2)]


def test_only_gaps_come_from_the_source(spark, points, monkeypatch):
    stored, source = points(STORED), points(SOURCE)
    names = sorted({p[0] for p in SOURCE})
    want = brute(STORED, SOURCE, names)
    assert rows_of(prepare.extend_history(stored, source, START, END)) == want
    monkeypatch.setattr(prepare, "NAMED_SERIES", 1)  # too many names for a filter
    assert rows_of(prepare.extend_history(stored, source, START, END)) == want


def test_series_asked_for(spark, points):
    stored, source = points(STORED), points(SOURCE)
    asked = spark.createDataFrame([("mid",), ("new",), ("mid",), ("unknown",), (None,)], "series_id string")
    assert rows_of(prepare.extend_history(stored, source, START, END, asked)) == brute(STORED, SOURCE, ["mid", "new"])


def test_empty_tables(spark, points):
    none = points(STORED).limit(0)
    source = [p for p in SOURCE if START <= p[1] < END]
    assert rows_of(prepare.extend_history(none, points(SOURCE), START, END)) == sorted(source)
    assert rows_of(prepare.extend_history(points(STORED), none, START, END, points(STORED))) == sorted(p for p in STORED if START <= p[1] < END)
    assert rows_of(prepare.extend_history(none, none, START, END)) == []


def test_the_gap_reaches_the_scan(spark, points, tmp_path):
    points(SOURCE).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    asked = spark.createDataFrame([("all",), ("left",)], "series_id string")
    got = prepare.extend_history(points([p for p in STORED if p[0] in ("all", "left")]), source, START, END, asked)
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,118)" in plan and "LessThan(ts,200)" in plan  # the stored points of `left` end at 117
    assert plan.count("PushedFilters") == 1  # nothing is missing on the left: one read of the source
    covered = prepare.extend_history(points(STORED), source, START, END, asked.where("series_id = 'all'"))
    assert "PushedFilters" not in covered._jdf.queryExecution().toString()
