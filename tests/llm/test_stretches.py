import random

from metricwatch.llm import spm
from test_tokens import ODD, unigram


def test_words_by_characters_equal_the_moving_window():
    model = spm.Model(spm._content(None))
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choices("abehinrstACEéüñ漢😀.,$-0123\t\n", k=rng.randint(1, 40))) for _ in range(2_000)]
    for word in words + ["▁", "▁▁▁", "漢", "▁the"]:
        assert model.short(word) == list(model.search(word)), word


def test_texts_return_without_decoding_them_again(monkeypatch):
    model = spm.Model(spm._content(None))
    texts = [t for t in ODD if t] + ["one two two", "a▁b"]
    ids = [model.encoded(t) for t in texts]
    want = [model.decode(i.tolist()) == t for t, i in zip(texts, ids)]
    assert want == [True] * (len(texts) - 1) + [False]
    monkeypatch.setattr(model, "decode", None)  # every stretch has been decoded
    assert [model.returns(t, i) for t, i in zip(texts, ids)] == want


def test_a_stretch_that_is_lost_has_its_texts_decoded():
    for content in (spm._content(None), unigram(spm._content(None))):
        model = spm.Model(content)
        model.byte_ids = {}  # characters without a piece become the unknown id
        for text in ("plain words", "\U00013000 gone", "plain words"):
            ids = model.encoded(text)
            back = model.decode(ids.tolist()) == text
            assert back == ("gone" not in text)
            assert model.returns(text, ids) == back
