"""Chunks tokenized together give what the tokenizer gives for whole texts."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factweave.llm.packing import _encoder, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
PARTS = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "日本", " ", "　", "'s", "12", "!?", "😀", "<|endoftext|>", "́", "\x1c", "\x85"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), max_size=6))
def test_chunks_equal_whole_texts(texts):
    wanted = [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert _encoder(PATH).ids(texts) == wanted
    assert token_ids(texts, PATH) == wanted


COMMON = st.text(st.sampled_from(list("aB1 \n\t\r'sét.,!²ªµ\xad½ñ$-_")), max_size=60)


@settings(max_examples=500, deadline=None)
@given(st.lists(COMMON, max_size=4))
def test_common_texts_equal_the_tokenizer(texts):
    wanted = [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert token_ids(texts, PATH) == wanted


def test_long_pieces_equal_the_tokenizer():
    texts = ["a" * 9000, " " * 9000 + "x", "\n" * 5000, "ab" * 5000 + "!" * 3000, "<|endoftext|> é" * 300]
    assert token_ids(texts, PATH) == [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
