from test_near_copies import brute, planted

import corpus_pipeline
from metricwatch.llm import near_copies, simhash


def test_the_stage_goes_through_simhash_and_verifies(spark, monkeypatch):
    docs, asked, checked, links, verified = planted(), [], [], near_copies.simhash_links, near_copies._verified

    def seen(fps, *rest):
        asked.append(fps.count())
        return links(fps, *rest)

    def noted(pairs, *rest):
        checked.append({tuple(r) for r in pairs.collect()})
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "simhash_links", seen)
    monkeypatch.setattr(near_copies, "_verified", noted)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, table, "").select("doc_id").collect()}
    assert {i for i, _ in docs} - kept == brute(docs)
    prints = {i: simhash.fingerprint(t, 5) for i, t in docs}
    assert len(asked) == 1 and 0 < asked[0] <= len(set(prints.values()))
    close = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    assert checked[0] and all(a < b and close(a, b) for a, b in checked[0])
    assert not any(checked[0] & more for more in checked[1:])  # the exact way takes the rest
