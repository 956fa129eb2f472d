import random

import numpy as np
import pytest
import sentencepiece

from metricwatch.llm import flat_tokens, spm

ODD = ["", " ", "  a", " \t\n x  y  ", "漢字 😀 مرحبا", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "1234567 999", "           deep", "x           ", "é"]


@pytest.fixture(scope="module")
def content():
    return spm._content(None)


def unigram(content):
    """The same pieces as a unigram model, with scores that make longer pieces worth their while."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(content)
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    rng = random.Random(4)
    for piece in spec.pieces:
        piece.score = -rng.randint(64, 144) / 16 - len(piece.piece) / 2  # sums are exact, so ties are ties
    return spec.SerializeToString()


@pytest.mark.parametrize("kind", ["merges", "unigram"])
def test_ids_equal_the_library(content, kind):
    content = content if kind == "merges" else unigram(content)
    model, library = spm.Model(content), sentencepiece.SentencePieceProcessor(model_proto=content)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("abehinrst ACEéüñ漢\n,.-0123_\t/=", k=rng.randint(1, 60))) for _ in range(1500)]
    texts.append("".join(rng.choices("abcdefghij", k=20_000)))
    for text in texts:
        assert model.encode(text) == library.encode(text), text[:60]
        assert model.decode(model.encode(text)) == text


def test_bounded_tables_change_nothing(content, monkeypatch):
    free, tight = spm.Model(content), spm.Model(content)
    text = " ".join(f"word{i} thing" for i in range(300))
    want = free.encode(text)
    monkeypatch.setattr(spm, "REMEMBERED", 3)
    monkeypatch.setattr(spm, "LOOK_EVERY", 1)
    assert tight.encode(text) == want


def test_unsplit_search_equals_split(content):
    model = spm.Model(content)
    text = "some words, and 12 more\nlines of them  here"
    want = model.encode(text)
    model.splits = False
    assert model.encode(text) == want


def test_encode_and_decode_tables(spark):
    rows = [(1, "hello there", "a"), (1, "hello there", "a"), (None, None, "b"), (2, "", "c"), (3, "a▁b", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {(r.id, r.n_ids > 0, r.returns) for r in spm.encode_checked(docs).collect()}
    assert out == {(1, True, True), (None, False, True), (2, False, True), (3, True, False)}
    texts = sorted((r.id or 0, r.text) for r in spm.decode(spm.encode(docs)).collect())
    assert texts == [(0, ""), (1, "hello there"), (1, "hello there"), (2, ""), (3, "a b")]
    assert spm.encode(docs.limit(0)).count() == 0


def scanned(spark, path, **options):
    return sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.start, r.n_tokens, r.closed) for r in flat_tokens.count_tokens(spark, str(path), **options).collect())


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_scan_of_hand_made_files(spark, tmp_path, block):
    files = {"a.bin": [5, 6, 2, 2, 7], "b.bin": [8, 9], "c.bin": [2, 4, 2], "d.bin": [], "e.bin": [3]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    apart = [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 1, False), ("b.bin", 0, 0, 2, False),
             ("c.bin", 0, 0, 0, True), ("c.bin", 1, 1, 1, True), ("e.bin", 0, 0, 1, False)]
    assert scanned(spark, tmp_path, block_tokens=block) == apart
    joined = [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("c.bin", 0, -3, 3, True), ("c.bin", 1, 1, 1, True), ("e.bin", 0, 0, 1, False)]
    assert scanned(spark, tmp_path, block_tokens=block, joined=True) == joined


def test_wide_tokens_and_broken_files(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(np.array([70_000, 50_256, 1], "<u4").tobytes())
    assert scanned(spark, tmp_path, eod=50_256, width=4) == [("w.bin", 0, 0, 1, True), ("w.bin", 1, 2, 1, False)]
    (tmp_path / "w.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        scanned(spark, tmp_path)


def test_written_files_count_as_the_library(spark, tmp_path, content):
    library = sentencepiece.SentencePieceProcessor(model_proto=content)
    texts = [None, *ODD, "some plain words"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    flat_tokens.write_flat(docs, str(tmp_path / "flat"))
    got = [(s, n, c) for _, _, s, n, c in scanned(spark, tmp_path / "flat")]
    want = [len(library.encode(t or "")) for t in texts]
    assert [(n, True) for n in want] == [(n, c) for _, n, c in got]
    assert [s for s, _, _ in got] == [sum(n + 1 for n in want[:i]) for i in range(len(want))]
