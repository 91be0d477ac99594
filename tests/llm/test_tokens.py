"""The piece-wise encoder against the whole tokenizer."""

from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figura.llm.tokens import Encoder, vocabulary

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENC = {n: Encoder(vocabulary(n), 2, room=50) for n in NAMES}
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\nb", "it's don't WE'LL", "x<|endoftext|>y z", "a\0b c", "é É ß Ÿ ﬁ İ ʼn",
       "é a", "a b c", "  lead", "trail\n", "1,234.5 (x) [y] --- ...", "naïve, café! über.", "日本 語", "a\tb c", "word. word, Word!!",
       "'s 't", "x 's y", "a's b'll", "\x85 a", "a b c", "ª º µ"]


def ids(raw: bytes) -> list[int]:
    return array("I", raw).tolist()


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", [*ODD, None])
def test_odd_texts(name, text):
    enc = ENC[name]
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids if text else []
    assert ids(enc.encode(text)) == [*want, 2]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbZé ß\n\t'.,!s1<|> ́日- "), max_size=40))
def test_random_texts(name, text):
    enc = ENC[name]
    assert ids(enc.encode(text))[:-1] == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_documents(name):
    import pyarrow.parquet as pq
    enc = Encoder(vocabulary(name))
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert ids(enc.encode(t)) == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", ["alpha\x1cbeta", "alpha\x1dbeta", "alpha\x1ebeta", "alpha\x1fbeta", "\x1f", "a \x1f b", "a\x1c \x1d", "x\x0by\x0cz\xa0\u2028w\u3000v"])
def test_information_separators(name, text):
    enc = ENC[name]
    assert ids(enc.encode(text))[:-1] == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé1. \n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000"), max_size=30))
def test_random_white_space(name, text):
    enc = ENC[name]
    assert ids(enc.encode(text))[:-1] == enc.tokenizer.encode(text, add_special_tokens=False).ids
