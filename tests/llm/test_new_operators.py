import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricwatch.llm import negatives, periodic, queries, url_rules


# periodic runs

def all_runs(words, shortest):
    """Every maximal stretch of equal words at a distance, the least period for each."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed):
    rng, texts = random.Random(seed), []
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 9])
        w = [f"w{rng.randint(0, letters)}" for _ in range(rng.randint(0, rng.choice([1, 5, 30, 100, 400])))]
        if w and rng.random() < 0.6:
            a = rng.randrange(len(w))
            p = rng.randint(1, 1 + (len(w) - a) // 2)
            w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
        texts.append(" ".join(w))
    a, b = "a", "b"
    for _ in range(8):  # a Fibonacci word: many runs over one another
        a, b = b, b + " " + a
    return [*texts, b, "x " * 500, "é  é\t" * 20 + "\n", None, "", " \n\t", "one"]


@pytest.mark.parametrize("shortest", [2, 3, 12])
def test_runs_equal_plain_loops(spark, shortest):
    rows = list(enumerate(periodic_texts(shortest)))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, "y " * 30)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, runs string, id int")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find(docs, shortest).collect()), key=str)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = all_runs(w, shortest)
        want.append((i, len(w), found, without_repeats(w, found)))
    assert got == sorted(want, key=str)
    assert periodic.find(docs.limit(0), shortest).count() == 0


def test_groups_and_chunks_do_not_matter(monkeypatch):
    texts = [(t or "").encode().split() for t in periodic_texts(9)]
    whole = periodic.runs_of_texts(texts)
    monkeypatch.setattr(periodic, "GROUP_WORDS", 50)
    monkeypatch.setattr(periodic, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic.runs_of_texts(texts)))
    with pytest.raises(ValueError):
        periodic.find(None, 1)


@pytest.mark.parametrize("letters", [1, 2, 50])
def test_extensions_by_hand(letters):
    rng = np.random.default_rng(letters)
    words = rng.integers(0, letters, 400).astype(np.int32)
    words[200:330] = words[20:150]
    a = rng.integers(0, 400, 3000)
    b = rng.integers(0, 401, 3000)
    a, b = np.minimum(a, b), np.maximum(a, b)
    a, b = a[a < b], b[a < b]
    plain = [next((k for k in itertools.count() if y + k >= 400 or words[x + k] != words[y + k])) for x, y in zip(a.tolist(), b.tolist())]
    extensions = periodic.Extensions(words)
    assert extensions.common(a, b).tolist() == plain
    assert extensions.rank is not None  # the sorted samples were used


def test_tails_of_the_query(spark, tmp_path):
    """The periodic tails and the digests against the contract in plain Python."""
    rng, rows = random.Random(2), [(None, "a b " * 20), (1000, None), (1001, "")]
    rows += [(i, " ".join(rng.choices("abcdefg", k=rng.randint(1, 90)))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    tails = 0
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n, tails = h // 10, len(w), tails + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        found = all_runs(w, 12)
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        assert got[i] == (len(found), s, n, q, 1000 * n // q if q else None, digest(listed), digest(without_repeats(w, found)))
    assert tails > 5 and len(got) == len(rows)


# hard negatives

def mined(rows, anchors, k=5, m=3):
    good = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    good = [(i, lab, [int(np.floor(x * 256)) for x in v]) for i, lab, v in good]
    good = [r for r in good if sum(float(x) * float(x) for x in r[2]) < 2.0**61]
    out = []
    for i, lab, v in good:
        if not anchors(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, u)), j, other) for j, other, u in good)
        for p, j, _ in [s for s in scores if s[2] == lab and s[1] != i][:k]:
            fit = [s for s in scores if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p][:m]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def embedded(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    rows = [(i, 0 if rng.random() < 0.5 else rng.randint(0, 4), [scale * (c + rng.gauss(0, 0.6)) for c in rng.choice(centres)]) for i in range(n)]
    inf = float("inf")
    rows += [(None, 1, [0.5] * width), (n, None, [0.5] * width), (n + 1, 1, None), (n + 2, 1, [None] * width), (n + 3, 1, [inf] * width), (n + 4, 2, [float("nan")] * width)]
    rows += [(5, 0, rows[5][2]), (5, 0, rows[5][2]), (10, 0, rows[11][2]), (n + 5, 1, []), (10 * n, 2, rows[3][2][: width // 2]), (n + 6, 0, [1e300] + [0.0] * (width - 1))]
    return rows


@pytest.mark.parametrize(("seed", "width", "scale", "chunk", "block"), [(1, 8, 1.0, 1 << 15, 1 << 14), (2, 33, 1e-3, 20, 7), (3, 6, 1e6, 50, 3), (4, 1500, 1.0, 64, 64)])
def test_negatives_equal_plain_loops(spark, seed, width, scale, chunk, block):
    rows = embedded(seed, 150, width, scale)
    frame = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, v string")
    got = negatives.mine(negatives.vectors(frame), F.col("vec_id") % 5 == 0, chunk=chunk, block=block)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda i: i % 5 == 0)
    assert negatives.mine(negatives.vectors(frame.limit(0)), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.mine(negatives.vectors(frame), F.lit(False)).count() == 0


@pytest.mark.parametrize(("width", "top"), [(1, 1), (3, 10), (64, 300), (64, 2**27), (5000, 1000)])
def test_products_are_exact(width, top):
    rng = np.random.default_rng(width + top)
    a, b = (rng.integers(-top, top + 1, (13, width)) for _ in range(2))
    a[0], b[0], b[1] = top, top, -top
    moduli = negatives.primes(width, width * top * top)
    assert len(set(moduli)) == len(moduli) and all(p % d for p in moduli for d in range(2, p))
    assert min(width, negatives.SPAN) * (max(moduli) // 2) ** 2 <= negatives.EXACT
    got = negatives.products(negatives.residues(a, moduli), negatives.residues(b, moduli), moduli)
    assert got.tolist() == (a.astype(object) @ b.astype(object).T).tolist()


# URL filters

RULES = [
    url_rules.Rule("a", "||net/", "block", 1), url_rules.Rule("b", "||example.net/en/", "allow", 1), url_rules.Rule("c", "||my-shop.org^", "block"),
    url_rules.Rule("d", "/ads/*.gif|", "block"), url_rules.Rule("e", "|www.", "allow"), url_rules.Rule("f", "banner", "block"), url_rules.Rule("g", "/a+b(c)/", "block"),
    url_rules.Rule("h", "*/x^y*", "allow"), url_rules.Rule("i", "/ads/*.gif|", "allow"), url_rules.Rule("j", "|", "block", -1), url_rules.Rule("k", None, "block", 9),
]
URLS = [
    None, "", "no scheme/at all", "http://", "https://NET/", "https://net", "https://a.Example.net/en/1?x=/fr/", "https://example.net/EN/1", "https://badexample.net/en/",
    "https://notnet.com/", "http://my-shop.org", "http://my-shop.org:80/", "http://my-shop.organic/", "http://x.com/ads/a/b.gif", "http://x.com/ads/b.gif#f", "http://x.com/ads/b.gif.html",
    "http://www.x.com/", "http://x.com/www.", "http://x.com/mybanners/", "http://x.com/a+b(c)/", "http://x.com/aab(c)/", "http://x.com/q/x/y", "http://x.com/q/x", "http://user@net/a://b.org/", "ftp://é.net/é?",
    "http://x.net/a\nb", "https://K.net/",
]


def fits(pattern, address):
    front = r"^(?:[^/]*\.)?" if pattern.startswith("||") else "^" if pattern.startswith("|") else ""
    pattern = re.sub(r"^\|{1,2}", "", pattern)
    end = r"\Z" if pattern.endswith("|") else ""
    body = "".join({"*": "(?s:.*)", "^": r"(?:[^0-9A-Za-z_.%-]|\Z)"}.get(c, re.escape(c)) for c in re.sub(r"\|$", "", pattern))
    return re.search(front + body + end, address) is not None


def judged(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    won = max((r for r in rules if r.pattern is not None and fits(r.pattern, host + path)), key=lambda r: (r.level, len(r.pattern), r.verdict == "allow", r.pattern, r.name), default=None)
    return (host, path, *(won[:3] if won else (None, None, "allow")), won.level if won else None)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("rules", [RULES, RULES[:4], RULES[10:], []])
def test_rules_equal_trying_all(spark, monkeypatch, rules, small):
    if not small:
        monkeypatch.setattr(url_rules, "INDEX_BYTES", -1)
    rows = [(i, u, "h", "t") for i, u in enumerate(URLS)] + [(None, URLS[6], None, None), (3, URLS[6], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string")
    table = url_rules.rule_table(spark, rules)
    got = url_rules.judge(pages, table)
    assert got.columns == [*pages.columns, "judged"]
    assert sorted(((r.page_id, tuple(r.judged)) for r in got.collect()), key=str) == sorted(((i, judged(u, rules)) for i, u, _, _ in rows), key=str)
    assert url_rules.judge(pages.limit(0), table).count() == 0


def test_candidates_come_by_the_rarest_token(spark):
    """Only addresses with a rule's rarest token are tried."""
    assert spark.range(1).select(url_rules.bounded_tokens(F.lit("||Ads.example*net/open^a-b"))).first()[0] == ["ads", "open", "a"]
    with pytest.raises(ValueError):
        url_rules.judge(spark.createDataFrame([("a", 1)], "url string, judged int"), url_rules.rule_table(spark, RULES))
