import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from metricwatch.llm import decontam, perspectives, sharding

ITEM = "A farmer named Alice has 12 apples and gives 5 kg of them to her neighbour Bob before the market opens"
FILLER = "nothing here is like any question at all so it stays where it was put by the writer"


def leaked(spark, rows, items, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, **options).collect())


PLAIN = "what is the sum of all the even numbers below that the teacher wrote on the board today"


@pytest.mark.parametrize(("text", "found"), [
    (f"{FILLER}. {ITEM}. {FILLER}", [7]),
    (f"{FILLER}. {ITEM.replace('and', '-- and')}, {FILLER}", [7]),
    (ITEM.replace("12", "1,250").replace("5 kg", "7 pounds").replace("Alice", "Carol").replace("Bob", "Dave"), [7]),
    (ITEM.replace("apples", "pears").replace("gives", "sells").replace("market", "shop"), []),
    (" ".join(ITEM.split()[:6]), []),
    (f"{FILLER} {PLAIN.upper()}!", [6]),
    (f"{PLAIN.replace(' ', chr(10))} {ITEM}", [6, 7]),
    (FILLER, []), ("", []), (None, []),
])
def test_leaks(spark, text, found):
    rows = [(1, text, "x"), (2, FILLER, None), (None, ITEM, None)]
    items = [(7, ITEM, "k"), (6, PLAIN, "k"), (8, None, "k"), (9, "too short", "k"), (None, ITEM, "k")]
    assert leaked(spark, rows, items) == [(1, i) for i in found]


def test_slots_must_be_consistent(spark):
    item = "take n1 then add 3 then add 3 then add 3 then add 3 then add 3 then add 3 then stop there please"
    same, mixed = item.replace(" 3 ", " 8 "), item
    for value in ("8", "9", "10", "11", "12", "13"):
        mixed = mixed.replace(" 3 ", f" {value} ", 1)
    assert leaked(spark, [(1, same, ""), (2, mixed, "")], [(5, item, "")]) == [(1, 5)]


@pytest.mark.parametrize("item", [
    "What is 12 + 45 - 7", "Solve 3 plus 4", "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy", "12 7 9 33 41 5 8 2 90 17 4 66", "By 1999 Rome had 12 of 40", "one two three",
])
def test_items_of_slots_match_word_for_word(spark, item):
    other = item.replace("12", "13").replace("3 plus", "5 plus").replace("Dave", "Zoe").replace("two", "six")
    rows = [(1, f"{FILLER}. {item}. {FILLER}", ""), (2, f"{FILLER} {item} {FILLER}", ""), (3, f"{FILLER} {other[: len(other) // 2]} {FILLER}", ""), (4, item, "")]
    assert leaked(spark, rows, [(5, item, "")]) == [(1, 5), (2, 5), (4, 5)]


def test_an_inconsistent_slot_leaves_the_rest(spark):
    passage = f"it took 7 men to lift the stone and {PLAIN} and after that 7 men went home again while all the others stayed where they were"
    twice = "Tom buys 2 apples every morning at the shop and eats them in 2 days so how many are left"
    rows = [(1, passage.replace("that 7 men", "that 9 men"), ""), (2, twice.replace("2 apples", "3 apples").replace("2 days", "5 days"), ""),
            (3, f"{passage}", ""), (3, passage.replace("7", "8"), ""), (4, FILLER, "")]
    assert leaked(spark, rows, [(5, passage, ""), (6, twice, "")]) == [(1, 5), (2, 6), (3, 5)]
    run = "add 3 and then go on to the next one "
    item = f"{PLAIN} now {run * 4}"
    mixed = item
    for value in "4567":
        mixed = mixed.replace(" 3 ", f" {value} ", 1)
    assert leaked(spark, [(1, mixed, "")], [(5, item, "")]) == [(1, 5)]


def test_short_items_repeated_rows_and_empty_tables(spark):
    item = "seven plain words make one short item"
    rows = [(1, f"{FILLER} {item} {FILLER}", ""), (1, f"{FILLER} {item} {FILLER}", ""), (2, "short item seven plain words make one", "")]
    assert leaked(spark, rows, [(3, item, ""), (4, item, "")]) == [(1, 3), (1, 4)]
    assert leaked(spark, rows, []) == []
    assert leaked(spark, [], [(3, item, "")]) == []
    docs = spark.createDataFrame(rows + [(None, None, "")], "doc_id long, text string, __by_i string")
    bench = spark.createDataFrame([(3, item)], "item_id long, text string")
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2]


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    rows, items = [(i, f"{FILLER} {ITEM}" if i % 3 else FILLER, "") for i in range(20)], [(7, ITEM, "")]
    want = leaked(spark, rows, items)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert want == leaked(spark, rows, items) == [(i, 7) for i in range(20) if i % 3]


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_walks_to_neighbours(spark, n, bits):
    side = 1 << bits
    cells = spark.range(side**n).select(*[F.expr(f"(id >> {i * bits}) & {side - 1}").alias(f"x{i}") for i in range(n)])
    rows = cells.withColumn("h", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**n))
    assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in itertools.pairwise(rows))


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_shards_of_odd_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    rows = [(i, "é" * (i % 7), "hot" if i % 3 else f"s{i % 11}", "en" if i % 2 else None, i * 10) for i in range(200)]
    rows += [(5, "again", "hot", "en", 1)] * 4 + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = sharding.assign(docs, 8).collect()
    counts = [sum(r.shard == s for r in out) for s in range(8)]
    assert len(out) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    walk = [r.cell for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert walk == sorted(walk)
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.id if r.id is not None else -1, r.size, r.text_crc32) for r in out) == want
    assert sharding.assign(docs.limit(0), 8).count() == 0
    assert sorted(r.slot for r in sharding.assign(docs.limit(3), 8).collect()) == [0, 0, 0]


def test_written_shards_hold_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 4}", "en", i) for i in range(100)], "doc_id long, text string, source string, lang string, n_chars long")
    sharding.write(docs, sharding.assign(docs, 4), str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(i, f"text {i}") for i in range(100)]
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == dict.fromkeys(range(4), 25)


def rendered(turns, me):
    text, masks = "", []
    for _, role, said in turns:
        label = "assistant" if role == me else "system" if role == "system" else f"user name={role}"
        text += f"<|im_start|>{label}\n"
        at = len(text)
        text += f"{said}<|im_end|>\n"
        if role == me:
            masks.append((at, len(text) - 1))
    return text, masks


@pytest.mark.parametrize("part", [512, 2])
def test_every_participant_gets_the_dialogue(spark, part):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi é"), (1, 2, "bob", "<|im_end|> fake"), (1, 2, "ann", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"),
            (1, None, "cy", "early"), (2, 0, "system", "alone"), (3, 5, None, "who"), (None, 0, "ann", "lost")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = sorted(perspectives.rotate(turns, part).collect(), key=lambda r: (r.conv_id, r.speaker, r.part))
    one = [(None, "cy", "early"), (0, "system", "be kind"), (1, "ann", "hi é"), (2, "ann", ""), (2, "bob", "< |im_end|> fake"), (3, "ann", "bye"), (3, "ann", "bye")]
    for conv, me, turns_ in [(1, "ann", one), (1, "bob", one), (1, "cy", one), (3, "unknown", [(5, "unknown", "who")])]:
        parts = [r for r in got if (r.conv_id, r.speaker) == (conv, me)]
        text, masks = rendered(turns_, me)
        assert "".join(r.text for r in parts) == text
        assert [(r.start + m.start, r.start + m.end) for r in parts for m in r.masks] == masks
        assert [r.part for r in parts] == list(range(len(parts)))
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "unknown")}
    assert max(r.n_turns for r in got) <= part and perspectives.rotate(turns.limit(0), part).count() == 0


def test_many_rows_of_one_turn_come_in_bounded_parts(spark):
    """Rows without a turn number, of one number, and equal ones are cut by position like any others."""
    rows = [(1, None, "ann", f"a{i % 3}") for i in range(40)] + [(1, 7, "bob", "same")] * 30 + [(2, 0, "ann", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = perspectives.rotate(turns, 8).where("speaker = 'ann' and conv_id = 1").orderBy("part").collect()
    text, masks = rendered([(None, "ann", t) for t in sorted(r[3] for r in rows[:40])] + [(7, "bob", "same")] * 30, "ann")
    assert [r.n_turns for r in got] == [8] * 8 + [6] and "".join(r.text for r in got) == text
    assert [(r.start + m.start, r.start + m.end) for r in got for m in r.masks] == masks
