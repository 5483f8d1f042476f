"""The op5 and op6 encoder against the library, on spellings of its added tokens."""

import numpy as np
import public_tokenizers as P
import pytest

from quire.llm import sstable


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "<|EndOfText|> x", "a<|StartOfText|>B", "X<|endoftext|>Y", "<|ENDOFTEXT|><|endoftext|>", "É<|ENDOFTEXT|>.", "ABC. Straße, <|X|>"])
def test_added_tokens_in_other_cases(text):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    encode, _, width = sstable.encoder(path)
    assert np.frombuffer(encode(text), f"<u{width}").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
