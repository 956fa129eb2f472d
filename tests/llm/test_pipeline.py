import os
import re

import sentencepiece
from test_near_copies import brute as near_copies_dropped
from test_quality_pii import by_hand  # noqa: F401 - the measures, by hand

import corpus_pipeline
from metricwatch.llm import pii, quality, spm

LINE = "the word{0} of note{1} and a thing{2} is in place{3} as it was "


def clean(seed):
    return "".join(LINE.format(*(seed * 97 + i * k for k in (3, 5, 7, 11))) for i in range(12)).strip() + "."


def brute(docs, items):
    """The five stages by plain loops; leaks are items that a document holds word for word."""
    good = []
    for row in docs:
        n, chars, symbols, dup, repeated = by_hand(row[1])
        ws = (row[1] or "").split()
        stop, capitals = sum(w.lower() in quality.STOP_WORDS for w in ws), sum(c.isupper() for w in ws for c in w)
        lines = len([x for x in (row[1] or "").split("\n") if x.strip()])
        if n >= 50 and 2 * repeated <= n and 2 * n <= chars <= 16 * n and symbols <= n / 4 and stop >= n / 50 and capitals <= 0.3 * chars and dup <= lines / 2:
            good.append(row)
    dropped = near_copies_dropped([(row[0], row[1]) for row in good])
    single = [row for row in good if row[0] not in dropped]
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    safe = [row for row in single if not any(words(x) in words(row[1]) for _, x in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    return sorted((row[0], library.encode(pii.redact_text(row[1]))) for row in safe)


def test_stages_equal_plain_loops(spark, tmp_path):
    item = "how many of the small stones did the old man carry over the hill before the rain came down"
    docs = [(i, clean(i)) for i in range(1, 13)]
    tokens = clean(50).split()
    docs += [(40, " ".join(tokens)), (41, " ".join([*tokens[:60], "another", *tokens[61:]])), (42, " ".join([*tokens[::-1][:30], *tokens]))]  # 41 is near 40 by words, not by 3 bits; 42 is not
    docs += [(20, clean(1)), (21, clean(2) + " end"), (22, clean(30) + " " + item + " " + clean(31)), (23, clean(32) + " mail bob (at) example [dot] com or 10.1.2.3 "),
             (24, None), (25, ""), (26, "short one"), (27, clean(33).upper()), (28, re.sub(" ", "*** ", clean(34))), (29, ("same line again\n" * 60))]
    items = [(1, item), (2, "nobody ever asked this in any of the documents that were put here today")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == brute(docs, items)
    assert all(r.returns for r in got.collect())


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, clean(1), "x", "__q_h"), (None, None, None, None)], "doc_id long, text string, lang string, id string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.where("doc_id = 1").count() == rows.where("doc_id = 1").count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()


def test_registered_with_the_other_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}
    assert os.path.exists(spm.default_model())
