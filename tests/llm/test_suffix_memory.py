import random
import tracemalloc

import numpy as np
import pyarrow as pa

from metricwatch.llm import suffixes
from metricwatch.session import prepare


def test_a_shard_takes_few_bytes_for_each_of_its_own():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3_000)]
    pieces = [b" ".join(rng.choices(words, k=70)) for _ in range(6_000)]
    pieces += pieces[:500]
    size = sum(map(len, pieces))
    tracemalloc.start()
    again = suffixes.repeated_starts(pieces, [len(p) - 199 for p in pieces], 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [bool(a.all()) for a in again] == [True] * 500 + [False] * 5_500 + [True] * 500
    assert peak < 50 * size


def test_hashes_by_steps_find_the_same_repeats(monkeypatch):
    rng = random.Random(6)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    counts = [len(p) - 19 for p in pieces]
    wins = [p[i : i + 20] for p, n in zip(pieces, counts) for i in range(n)]
    for step in (9, 64, 1 << 20):
        monkeypatch.setattr(suffixes, "STEP", step)
        found = np.concatenate(suffixes.repeated_starts(pieces, counts, 20, 30))
        assert found.tolist() == [wins.count(w) > 1 for w in wins]


def test_workers_take_long_texts_by_bytes(spark):
    prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('long text ', 10000) AS t")
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 10 << 20
