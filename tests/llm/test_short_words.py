import random

from metricwatch.llm import spm


def test_short_words_have_the_pieces_of_the_full_search(monkeypatch):
    """A word remembered by a merge model is searched by the short form only, and gets the same pieces."""
    model, rng = spm.Model(spm._content(None)), random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu-0é漢") for _ in range(rng.randint(1, 20))) for _ in range(400)] + ["x" * spm.LOOK_EVERY, "the", "internationalisation"]
    expected = {w: list(model.search(spm.SPACE_MARK + w)) for w in words if len(w) < spm.LOOK_EVERY}
    assert all(model.short(spm.SPACE_MARK + w) == pieces for w, pieces in expected.items())
    fresh, long = spm.Model(spm._content(None)), []
    search = fresh.search
    monkeypatch.setattr(fresh, "search", lambda text: long.append(text) or search(text))
    ids = fresh.encode(" ".join(words))
    assert ids == [i for w in words for piece in model.search(spm.SPACE_MARK + w) for i in model.written(piece)]
    assert long == [spm.SPACE_MARK + "x" * spm.LOOK_EVERY]
