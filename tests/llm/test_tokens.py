"""Cached, piecewise encoding against the library's encoding of the whole text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweave.llm.tokens import Encoder, vocabulary

ALPHABET = "abcXYZ012 \t\n.,;:!?'-_<|>/éÉßİıǅŉσΣς́  ʰɐж中"
TEXTS = st.text(st.sampled_from(ALPHABET), max_size=40) | st.text(max_size=20)


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def encoder(request):
    return Encoder(vocabulary(request.param), cache=50)


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_same_ids_as_whole_texts(encoder, text):
    assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
