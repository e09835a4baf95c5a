"""The encoder's shortcuts give what the plain way gives, with less looking up."""

import random

import numpy as np
import pytest

from barloom.llm import pieces


@pytest.fixture(scope="module")
def tables():
    return pieces.Tables(*pieces.load_pieces(pieces.default_model()))


def test_pairs_stand_apart_as_merging_has_it(tables):
    rng, ids = random.Random(3), list(tables.ids.values())
    for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(3000)):
        assert tables.stable(a, b) == (tables.merge(tables.piece[a] + tables.piece[b]) == [tables.piece[a], tables.piece[b]])


def test_words_with_common_beginnings_are_not_begun_again(tables, monkeypatch):
    import sentencepiece

    library, rng, looked = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), random.Random(4), []

    class Counting(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    monkeypatch.setattr(tables, "ids", Counting(tables.ids))
    words = [f"onthere{a}{b}{mark}" for a in "aeiourst" for b in "ndlmgcht" for mark in ("", "&&&", ",-", "x")]
    rng.shuffle(words)
    for word in words:
        assert np.frombuffer(tables.encode(word), np.int32).tolist() == library.encode(word), word
    assert len([k for k in looked if k == "▁onth"]) <= 2
