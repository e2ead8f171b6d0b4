import random

import numpy as np
import pytest

from seqlab.operators import hmm
from seqlab.sources.corpora import tokens
from tests.conftest import make_sentences

TAGS = ["A", "B", "C"]


def made_up(rng, n, length):
    out = []
    for _ in range(n):
        size = rng.randint(1, length)
        out.append([(f"w{rng.randint(0, 8)}", rng.choice(TAGS)) for _ in range(size)])
    return out


def decoded(rows, counts, grid, **settings):
    got = hmm.viterbi(rows, counts, grid, **settings).collect()
    out = {}
    for r in sorted(got, key=lambda r: r.pos):
        own = out.setdefault((r.src_id, r.l1), [[], [], r.score])
        assert r.pos == len(own[0])
        own[0].append(r.word)
        own[1].append(r.pred)
    return out


@pytest.mark.parametrize("chunk", [2, 16])
def test_chunks_decode_as_whole_sequences(spark, chunk):
    """Long and short sequences, unseen words, two settings: the same paths and scores."""
    rng = random.Random(chunk)
    sents = made_up(rng, 30, 40) + [[(f"new{k}", "A") for k in range(20)], [("w1", "A")]]
    packed = make_sentences(spark, sents)
    train = make_sentences(spark, made_up(random.Random(5), 60, 12))
    counts = hmm.train(train, tokens(train))
    grid = [(0.6, 0.3), (0.2, 0.1)]
    whole = decoded(tokens(packed), counts, grid)
    cut = decoded(tokens(packed), counts, grid, chunk=chunk)
    assert whole.keys() == cut.keys()
    for key, (words, path, score) in whole.items():
        assert cut[key][0] == words and cut[key][1] == path
        assert cut[key][2] == pytest.approx(score, abs=1e-9)


def test_matrix_products_are_associative():
    from seqlab.operators import chunked_paths as c

    rng = np.random.default_rng(0)
    log_q = np.log(rng.random((3, 3, 3)))
    emits = [rng.random(2) for _ in range(9)]
    whole = c.matrix(emits, log_q)
    parts = [c.matrix(emits[a : a + 2], log_q) for a in range(0, 9, 2)]
    left = parts[0]
    for p in parts[1:]:
        left = c.product(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = c.product(p, right)
    assert np.allclose(whole, left) and np.allclose(whole, right)


def test_large_tag_sets_are_decoded_whole(spark, monkeypatch):
    monkeypatch.setattr(hmm, "MAX_STATES", 4)
    train = make_sentences(spark, made_up(random.Random(5), 20, 12))
    counts = hmm.train(train, tokens(train))
    assert decoded(tokens(train), counts, [(0.6, 0.3)], chunk=2) == decoded(tokens(train), counts, [(0.6, 0.3)])
