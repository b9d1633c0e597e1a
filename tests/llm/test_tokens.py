import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkwright.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(DEFINITION)


def same(text):
    want = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    ids, counts = ENCODER.encode(["It's", text, None, "'", text, "s"])
    ids = np.split(ids.tolist(), np.cumsum(counts)[:-1])
    assert len(counts) == 6 and ids[1].tolist() == want and ids[4].tolist() == want
    assert ENCODER.encode([text])[0].tolist() == want


def test_recognised():
    assert ENCODER.by_word


@pytest.mark.parametrize("text", [None, "", " \n\t ", "It's 2024, isn't IT?", "a<|endoftext|>b x", "é É Å ŒUVRE ﬁ ½²", "a\x1cb\x85c\xa0d  e", "''s .'ll 'D ''", "x" * 3000, "日本 語 🙂 é ́", "İ ẞ ǅ Σς"])
def test_special(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '.,sdtrevmlLAé9\n<|>"))))
def test_any(text):
    same(text)


def test_full_table_is_emptied():
    small = Encoder(DEFINITION, most=5)
    texts = ["one two three four five six seven", "eight nine ten one two", None, "one"]
    want = [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, counts = small.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr("linkwright.llm.tokens.BLOCK", 64)
    texts = ["It's a long, long text: " * 40, "x" * 500, "né " * 200 + "🙂 " + "y" * 300, None, " " * 300]
    ids, counts = ENCODER.encode(texts)
    want = [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
