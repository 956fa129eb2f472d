import random

import pytest

import corpus_pipeline
from metricwatch.llm import near_copies


def near(a, b):
    """Jaccard similarity of five-word shingles is at least 0.8."""
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(docs):
    kept = []
    for i, t in sorted(docs):
        if not any(near(t, other) for _, other in kept):
            kept.append((i, t))
    return {i for i, _ in docs} - {i for i, _ in kept}


def planted(seed=3):
    """Groups of texts with words changed at a few places, around the limit on both sides, in mixed order of ids."""
    rng, texts = random.Random(seed), []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 300))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    texts += ["one two three", "One two  three", "", " ", "one two four"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("light", "growth", "followers", "small"), [(64, 8, 256, True), (1, 8, 1, True), (1, 2, 3, False)])
def test_what_is_dropped_equals_plain_loops(spark, monkeypatch, light, growth, followers, small):
    monkeypatch.setattr(near_copies, "GROWTH", growth)
    monkeypatch.setattr(near_copies, "FOLLOWERS", followers)
    if not small:
        monkeypatch.setattr(near_copies, "BROADCAST_IDS", 0)
    docs = planted()
    expected = brute(docs)
    assert 30 < len(expected) < 80
    frame = spark.createDataFrame([*docs, (None, docs[0][1]), docs[3], (docs[5][0], docs[9][1])], "doc_id long, text string")
    if docs[5][0] in expected:  # an id with two texts goes if one of them does
        assert docs[5][0] in {r.id for r in near_copies.copies_to_drop(frame, light=light).collect()}
    frame = spark.createDataFrame([*docs, (None, docs[0][1]), docs[3]], "doc_id long, text string")
    assert {r.id for r in near_copies.copies_to_drop(frame, light=light).collect()} == expected
    assert near_copies.copies_to_drop(frame.limit(0)).count() == 0


def test_templates_make_few_pairs(spark, monkeypatch):
    """2,000 pages of one template with a sixth of their own: no pair of them is compared, none goes."""
    rng, seen = random.Random(8), []
    template = [f"t{rng.random()}" for _ in range(250)]
    docs = []
    for i in range(2000):
        cut = rng.randrange(250)
        docs.append((i, " ".join(template[:cut] + [f"o{rng.random()}" for _ in range(50)] + template[cut:])))
    alike = near_copies._alike

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(near_copies, "_alike", counted)
    frame = spark.createDataFrame([*docs, (5000, docs[7][1] + " and more")], "doc_id long, text string").repartition(8)
    assert [r.id for r in near_copies.copies_to_drop(frame).collect()] == [5000]
    assert sum(seen) < 4000


def test_signatures_never_rule_out_a_near_pair():
    rng = random.Random(4)
    for n in (1, 3, 63, 64, 65, 700, 40_000):
        a = near_copies.shingles(" ".join(f"w{rng.random()}" for _ in range(n + 4)))
        assert len(a) == n
        b = a.copy()
        b[: n // 10] += 1
        x, y = near_copies.parity(a), near_copies.parity(b)
        assert sum(int(v).bit_count() for v in (x ^ y).view("uint64")) <= 2 * (n // 10)


def test_stage_drops_copies_that_simhash_misses(spark, tmp_path):
    docs = planted(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame, str(tmp_path)).collect()}
    assert kept == {i for i, _ in docs} - brute(docs)
