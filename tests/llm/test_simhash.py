import random

import pytest
import xxhash

from metricwatch.llm import simhash
from metricwatch.llm.components import components


def brute_fingerprint(text):
    tokens = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a b a b a b a b", "Ünïcode stays Ünïcode É é x"])
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=900))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("heavy", [10**6, 0, 3])
def test_links_connect_exactly_those_within_three_bits(spark, heavy):
    rng = random.Random(7)
    values = {0, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            value = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << bit
            values.add(value)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), heavy).collect()
    near = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert {(min(r), max(r)) for r in got} <= near
    assert brute_components(signed, [tuple(r) for r in got]) == brute_components(signed, near)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute_components({n for p in pairs for n in p}, pairs)


def test_near_duplicates_of_odd_rows(spark):
    body = " ".join(f"w{i}" for i in range(400))
    rows = [(5, body, "x"), (3, body, "y"), (3, body, "y"), (None, body, "z"), (8, body + " more", None), (9, None, ""), (10, "", ""), (11, "alone here now", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.id, r.component) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert bin(prints[5] ^ prints[8]).count("1") <= 3
    assert got == {(5, 3), (3, 3), (None, 3), (8, 3), (9, 9), (10, 9), (11, 11)}
    assert sorted(r.id for r in simhash.copies_to_drop(docs).collect()) == [5, 8, 10]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
