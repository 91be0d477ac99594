"""What a task holds and computes once per word."""

import tracemalloc

import numpy as np

from figura.llm import spelling
from figura.llm.tokens import Encoder, vocabulary
from figura.llm.wavelet import WaveletMatrix


def test_forms_of_a_word_are_given_to_the_model_once():
    enc = Encoder(vocabulary("word_bpe_49k.json"), 2)
    asked, ask = [], enc.tokenize
    enc.tokenize = lambda x: asked.append(x) or ask(x)
    for t in ("Word, wOrd WORD).", "wOrd!", "(word", None, "a  b\n É é"):
        assert enc.encode(t) == (enc._whole(t) if t else b"") + enc.end
    assert asked.count("word") == 1 and "word" in enc.known


def test_ids_around_sixteen_bits_come_back():
    rng = np.random.default_rng(3)
    for top in (1, 2, 255, 65_535, 65_536, 1 << 20):
        ids = np.r_[rng.integers(0, top, 3_000), top, 0].astype(np.uint32)
        m = WaveletMatrix.build(ids)
        assert m.all().dtype == np.uint32 and (m.all() == ids).all() and (m.access(np.arange(0, 3_002, 7)) == ids[::7]).all()
        assert m.count(top) == (ids == top).sum() and m.zeros == WaveletMatrix.build(ids.astype(np.int64)).zeros
    assert len(WaveletMatrix.build(np.zeros(0, np.uint32)).all()) == 0


def test_queries_of_large_groups_read_a_bounded_number_of_cells(monkeypatch):
    rng = np.random.default_rng(5)
    words = sorted({"".join(w) for w in rng.choice(list("abcdefghij"), (9_000, 6))})
    letters = spelling._letters(words, 6)
    lo, hi = np.zeros(len(words), int), np.full(len(words), len(words))
    lo[5], hi[5] = 9, 9

    def run():
        index = spelling.BitIndex(letters)
        tracemalloc.start()
        x, y = index.one_edit(letters, lo, hi)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return x, y, peak
    x, y, peak = run()
    assert peak < 40e6
    far = (letters[x] != letters[y]).sum(axis=1)
    assert (far == 1).all() and 5 not in x
    monkeypatch.setattr(spelling, "_CELLS", 1 << 40)
    x1, y1, peak1 = run()
    assert (x == x1).all() and (y == y1).all() and peak1 > 2 * peak
    assert [len(a) for a in spelling.BitIndex(letters).one_edit(letters[:0], lo[:0], hi[:0])] == [0, 0]
