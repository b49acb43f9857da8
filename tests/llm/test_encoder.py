"""What an encoder does once for many pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from loomspark.llm import tokens
from loomspark.llm.queries import vocabulary

TEXTS = ["", "one", " one", "one  two", "a.b, c! d?", "über naïve Straße, мир и слово.", "x\n\ny \n z", "tab\tand blank à b", "end ", "　 wide　blank", "don't 12,345 é. \U0001f600! <|endoftext|> ok."]


@pytest.fixture
def enc():
    return tokens.Encoder(vocabulary())


def same(enc, texts):
    ids, first = enc.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in enc._tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


@pytest.mark.parametrize("joined", [1, 2, 64])
def test_ids_are_those_of_whole_texts(enc, monkeypatch, joined):
    monkeypatch.setattr(tokens, "JOINED", joined)
    same(enc, [*TEXTS, None])
    same(enc, [f"{a} {b}" for a in TEXTS for b in TEXTS])
    same(enc, [f"{a}{b}. {b}" for a in TEXTS for b in TEXTS])


def test_new_words_are_merged_many_at_once(enc):
    rng = np.random.default_rng(1)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyzéß"), (5000, 8))]
    calls, merged = [], enc._merged
    enc._merged = lambda texts: calls.append(len(texts)) or merged(texts)
    same(enc, ["first " + " ".join(words)])
    assert 0 < sum(calls) <= 5000 // tokens.JOINED + 2


def test_words_are_merged_apart_where_an_id_goes_over_the_end_of_one(enc):
    words = ["alpha", "beta", "gamma"]
    want = [enc._tokenizer.encode(" " + w, add_special_tokens=False).ids for w in words]
    enc._spelled = enc._spelled.copy()
    enc._spelled[want[1][-1]] += 1  # as if it held a letter of the next word
    ids, sizes = enc._words(" ", words)
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
