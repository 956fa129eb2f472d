import random
import tempfile

import numpy as np
import pytest

from metricwatch.llm import anchors, debruijn, suffixes


def words_left(rows, window):
    """(id, number of words, words that stay) by comparing every window with those of smaller ids."""
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = {j + k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < order(i) for k in range(window)}
        out.append((i, len(w), " ".join(x.decode() for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def bytes_left(rows, window):
    seen = {}
    for _, text in rows:
        b = (text or "").encode()
        for j in range(len(b) - window + 1):
            seen[b[j : j + window]] = seen.get(b[j : j + window], 0) + 1
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - window + 1):
            if seen[b[j : j + window]] > 1:
                gone[j : j + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, letters):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(letters, k=40))
    rows = [(None, None), (50, ""), (51, " \n"), (52, "few words")]
    for i in range(40):
        text = " ".join(rng.choices(letters, k=rng.randint(0, 60)))
        kind = rng.random()
        if kind < 0.3:
            a = rng.randint(0, 20)
            text += " " + passage[a : a + rng.randint(10, 60)] + "\n" + text[:20]
        elif kind < 0.5 and len(rows) > 8:
            text = rng.choice(rows[4:])[1]
        rows.append((rng.randint(1, 45) if kind > 0.9 else i + 100, text))
    rows += [(7, "é" * 70), (8, "é" * 75), (9, passage), (9, passage), (None, passage + " é tail")]
    return rows


@pytest.mark.parametrize(("seed", "window", "gram"), [(1, 13, 5), (2, 3, 2), (3, 2, 1), (4, 5, 3)])
def test_word_passages(spark, seed, window, gram):
    rows = corpus(seed, ["a", "b", "c", "dd", "E"] if window < 6 else [f"w{i}" for i in range(9)])
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, anchor string")
    got = debruijn.deduplicate(docs, window, gram).collect()
    assert sorted(((r.id, r.n_words, r.kept) for r in got), key=str) == words_left(rows, window)
    assert all(r.n_removed == r.n_words - len(r.kept.split()) for r in got)
    assert debruijn.deduplicate(docs.limit(0), window, gram).count() == 0


@pytest.mark.parametrize(("seed", "window", "gram", "limits"), [
    (1, 20, 6, {}), (2, 20, 6, {"hot": 0}), (3, 8, 3, {"shard_bytes": 100, "room": 7}), (4, 4, 2, {"hot": 2, "room": 5}),
])
def test_byte_strings(spark, seed, window, gram, limits):
    rows = corpus(seed, ["a", "b", "ab", "é"])
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, content string")
    got = suffixes.deduplicate(docs, window, gram, **limits).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == bytes_left(rows, window)
    assert suffixes.deduplicate(docs.limit(0), window, gram).count() == 0


@pytest.mark.parametrize("room", [3, 10**6])
def test_suffix_order_by_hand(room):
    rng = random.Random(1)
    for _ in range(60):
        units = [rng.randint(1, rng.choice([1, 2, 3, 250])) for _ in range(rng.randint(1, 300))] + [0]
        with tempfile.TemporaryDirectory() as folder:
            order = suffixes.suffix_order(np.array(units, np.int16), 10**6, folder, room)
        assert order.tolist() == sorted(range(len(units)), key=lambda i: units[i:])


def test_runs_do_not_depend_on_the_stretch(monkeypatch):
    units = anchors.mix(np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64))
    whole = anchors.runs(units, 13, 4)
    spread = lambda r: sorted((s + k, a) for a, s, n, _ in zip(*(x.tolist() for x in r)) for k in range(n))
    monkeypatch.setattr(anchors, "STRETCH", 37)
    assert spread(anchors.runs(units, 13, 4)) == spread(whole)
    assert sum(whole[2]) == 488
