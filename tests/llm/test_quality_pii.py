import random
import re

import pytest

from metricwatch.llm import pii, quality

CLEAN = " ".join(f"the word{i} of note{i * 7}" for i in range(40)) + "."


def by_hand(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_measures_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x x x x x", "# $ | <b>\n\n# $ | <b>\n \n", "é ü  ñ\x0b\x0cz\r\nq", CLEAN]
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 60))) + "\n" * rng.randint(0, 3) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, quality string")
    for row in quality.judge(docs).collect():
        m = row.quality.measures
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == by_hand(texts[row.doc_id]), texts[row.doc_id]
        assert row.quality.base_failed == (m.n_words < 50 or 2 * m.n_repeat_words > m.n_words)


def test_only_good_documents_stay_with_their_columns(spark):
    shout = " ".join(w.upper() + "!!" for w in CLEAN.split())
    stars = " ".join(w + "***" for w in CLEAN.split())
    rows = [(1, CLEAN, "k"), (1, CLEAN, "k"), (None, CLEAN, None), (2, shout, "k"), (3, stars, "k"), (4, None, "k"), (5, "", "k"), (6, "the same thing again " * 60, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(docs.collect()[:3], key=str)
    assert quality.keep_good(docs.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((pii.KINDS.index(kind), *m.span()))
    return found


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    parts = ["@", ".", "-", "+", " ", "a", "bob", "x.y", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "a@b.c", "@@", "é", "00", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == base_by_hand(text), text


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("write bob (at) example [dot] com now", "email", "bob (at) example [dot] com"),
    ("ann at mail dot host dot org", "email", "ann at mail dot host dot org"),
    ("so bоb@exаmple.com it is", "email", "bоb@exаmple.com"),
    ("bo​b@example.com", "email", "bo​b@example.com"),
    ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
    ("from １０.0.0.７ on", "ip", "１０.0.0.７"),
    ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises_are_found_at_their_source(text, kind, hidden):
    base = pii.base_spans(text)
    spans = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.hidden_spans(text, base)]
    assert spans == [(kind, hidden)]
    assert hidden not in pii.redact_text(text)


@pytest.mark.parametrize(("text", "base"), [
    ("bob@example.com (dot) uk", "email:0:15"), ("ask ann (dot) lee@example.com now", "email:14:29"), ("x 10.0.0.7 and bob@a.com[dot]au.", "email:15:24,ip:2:10"),
])
def test_an_identifier_disguised_in_part_counts_once(text, base):
    """The base span counts alone, and the whole identifier goes from the text."""
    spans = pii.base_spans(text)
    assert pii.listed(spans) == base and pii.hidden_spans(text, spans, longer=False) == []
    clean = pii.redact_text(text)
    assert clean.count("<email>") == 1 and "dot" not in clean and "uk" not in clean and "lee" not in clean


@pytest.mark.parametrize("text", ["", "look at the dot on the map", "one two", "He came at noon.", "zero tolerance, one way", "plain bob@example.com only"])
def test_plain_texts_have_nothing_hidden(text):
    assert pii.hidden_spans(text, pii.base_spans(text)) == []


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000) == []
    assert pii.base_spans("a" * 300_000 + "@") == []
    assert pii.base_spans("1." * 100_000)[0][0] == 1


def test_tables(spark):
    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    assert sorted((r.id or 0, len(r.base), len(r.hidden)) for r in pii.find(docs).collect()) == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0)]
    assert sorted(map(tuple, pii.redact(docs).collect()), key=str) == sorted([(1, "<email>", "x"), (1, "<email>", "x"), (None, None, None), (2, "", "y")], key=str)
    assert pii.find(docs.limit(0)).count() == 0
