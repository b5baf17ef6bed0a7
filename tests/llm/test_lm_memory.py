"""What tasks of the language model hold, and where its walks look."""

import pickle

import numpy as np

from codeprism.llm import lm


def _model(n=200, bits=12):
    top = [(b"w%d" % i, 1000 // (i + 1) + 1) for i in range(n)]
    return lm.Model(top, 5.0, bits), top


def test_held_words_travel_as_one_string():
    _, top = _model()
    held = lm.Words(top + [(lm.END, 1)])
    assert held.places([b"w3", b"absent", lm.END]).tolist() == [3, -1, 200]
    assert pickle.loads(pickle.dumps(held)).place is None
    assert lm.Words([]).places([lm.END]).tolist() == [-1]


def test_four_levels_of_a_walk_share_a_group_of_slots():
    model, top = _model()
    symbols = np.arange(len(top))
    one, two = model.contexts(symbols, np.array([0]))
    owner, _, slots = model.decisions(symbols, one, two)
    for table in slots[1:]:
        for i in symbols:
            assert len(set((table[owner == i] >> 4).tolist())) <= -(-model.code.size[i] // 4)
            for at in range(0, model.code.size[i], 4):
                assert len(set(part := table[owner == i][at : at + 4].tolist())) == len(part)


def test_counters_of_nodes_follow_from_counts_of_symbols():
    model, _ = _model()
    ids = np.random.default_rng(0).integers(0, 201, 5000)
    expected = np.zeros((model.code.inner, 2), np.int64)
    for i in ids:
        part = slice(model.code.start[i], model.code.start[i] + model.code.size[i])
        np.add.at(expected, (model.code.nodes[part], model.code.bits[part]), 1)
    assert (model.code.counters(np.bincount(ids, minlength=201)) == expected).all()
