"""The registered queries of this package, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.llm import debruijn, decontam, flat_tokens, negatives, periodic, perspectives, pii, quality, sharding, simhash, spm, suffixes, url_rules
from metricwatch.llm.common import let, shared_path, table, words
from metricwatch.session import prepare

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
# The measures and the verdict of quality.judge, one row per document of the relation `docs`.
QUALITY_CTES = rf"""
tok AS (SELECT doc_id, coalesce(text, '') AS text,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS solid FROM docs),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM tok)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY 1),
mea AS (SELECT tok.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(ls) AS n_lines, len(list_filter(ws, lambda w: lower(w) IN ({STOPS}))) AS n_stop,
  length(solid) - length(regexp_replace(solid, '\p{{Lu}}', '', 'g')) AS n_capital
  FROM tok LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM mea),
verdict AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 16 * n_words AND n_symbols <= 0.25 * n_words
  AND n_stop >= 0.02 * n_words AND n_capital <= 0.3 * word_chars AND n_dup_lines <= 0.5 * n_lines AS kept FROM judged)
"""


@query("op5_quality_rules", f"WITH docs AS (SELECT doc_id, text FROM documents), {QUALITY_CTES} SELECT * FROM verdict")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents", "doc_id", "text"))
    return judged.select("doc_id", "quality.measures.n_words", "quality.measures.word_chars", "quality.measures.n_symbols",
                         "quality.measures.n_dup_lines", "quality.measures.n_repeat_words", "quality.base_failed", "quality.kept")


@query("op2_simhash")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"), "copies")


@query("op9_decontamination")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontam.leaks(docs, table(spark, folder, "benchmark", "item_id", "text"))


@query("op10_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents", "doc_id", "text"))
    every = F.concat("base", "hidden")
    order = F.create_map(*[F.lit(x) for pair in zip(pii.KINDS, range(4)) for x in pair])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    ranked = F.sort_array(F.transform(every, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS],
                        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(ranked).alias("spans"))


@query("op1_sentencepiece")
def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return spm.encode_checked(table(spark, folder, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op3_sharding")
def hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source", "lang", "n_chars")
    placed = sharding.assign(docs, 8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "cell")


@query("op4_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat token files written from the documents, scanned without an index; the order of the rows names the documents."""
    docs, path = table(spark, folder, "documents", "doc_id", "text"), shared_path(spark)
    flat_tokens.write_flat(docs, path)
    counts = flat_tokens.count_tokens(spark, path).withColumn("task", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int"))
    # a task writes its rows in the order of the scan, and one file of them
    task = F.spark_partition_id().alias("task")
    order = docs.select("doc_id", task, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("ordinal"))
    joined = order.join(counts, ["task", "ordinal"], "full_outer")
    matched = F.when(F.col("n_tokens").isNull() | ~F.col("closed"), F.raise_error("files and documents differ")).otherwise(F.col("n_tokens"))
    return joined.select("doc_id", "task", "ordinal", "start", matched.cast("long").alias("n_tokens"))


CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM t),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
s AS (SELECT conv_id, speaker, pos // 512 AS place, pos, role = speaker AS own,
  '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
  text || '<|im_end|>' || chr(10) AS body FROM r JOIN p USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, place ORDER BY pos) AS stop FROM s),
g AS (SELECT conv_id, speaker, place, count(*) AS n_turns, string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(body)) || ':' || (stop - 1) END, ',' ORDER BY stop), '') AS masks FROM o GROUP BY ALL)
SELECT conv_id, speaker, CAST(place AS INT) AS part, n_turns, sum(length(text)) OVER w - length(text) AS start, text, masks
FROM g WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY place)
"""


@query("op7_chat_perspectives", CHAT_SQL)
def chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return perspectives.rotate(turns).withColumn("masks", spans)


@query("op6_substring_dedup")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    left = debruijn.deduplicate(table(spark, folder, "documents", "doc_id", "text"))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op8_suffix_array_dedup")
def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    left = suffixes.deduplicate(table(spark, folder, "documents", "doc_id", "text"))
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


HARD_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS own, b.vec_id AS other,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT own AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.vectors(rows, 256, label=label), F.col("vec_id") % 50 == 0)


PERIODIC_SQL = r"""
WITH c AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
  xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295::BIGINT)) AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM p),
w AS (SELECT doc_id, n, i, ws[i + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM d)),
e AS (SELECT doc_id, x.i AS i, y.i - x.i AS q FROM w x JOIN w y USING (doc_id, word) WHERE y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_runs, arg_max(r, [length, -start, -period]) AS top,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period,
  CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op12_periodic_runs", PERIODIC_SQL)
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One document in ten gets a periodic tail, as the contract asks; then all runs of every document."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tail = F.expr("h div 10")

    def tailed(ws):
        n = F.size(ws)
        start = F.col("g") % n
        period = F.lit(1) + F.floor((n - start) / (F.lit(3) + F.col("g") % 8))
        place = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, place(i))), " ")).otherwise("")

    docs = docs.withColumn("h", h).withColumn("g", tail)
    docs = docs.withColumn("text", F.when(F.col("h") % 10 == 0, let(words(F.col("text")), tailed)).otherwise(F.col("text")))
    found = periodic.find(docs)
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    top = F.array_max(F.transform("runs", order))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    found = found.withColumn("top", top)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
URL_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rhost, rpath, rverdict)),
f AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict
  WHEN regexp_matches('.' || host || path, '^[^/]*\.(ads|ads-track|spam-farm|casino)\.')
    OR contains(host || path, '-casino.') OR regexp_matches(host || path, '/(login|cart|checkout)([^0-9A-Za-z_.%-]|$)')
    OR contains(path, '/wp-admin/') OR ends_with(host || path, '.zip') OR ends_with(host || path, '.exe')
    OR regexp_matches(host || path, '(?s)/feed/.*/rss([^0-9A-Za-z_.%-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN f USING (host, path)
"""


@query("op13_url_filters", URL_SQL)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = url_rules.rule_table(spark, [*url_rules.DEFAULT_RULES, *(url_rules.host_rule(*r) for r in URL_RULES)])
    judged = url_rules.judge(table(spark, folder, "pages", "page_id", "url"), rules)
    rule = F.when(F.col("judged.level") == 1, F.col("judged.name"))
    return judged.select("page_id", "judged.host", "judged.path", rule.alias("rule"), "judged.verdict")
