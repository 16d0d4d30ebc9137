"""Ids put together from words against the library, for texts of every kind and tables of every size."""

import random

import numpy as np
import public_tokenizers
import pytest

from framewright.llm import bpe
from framewright.llm.common import chunks
from framewright.llm.word_ids import LONGEST, WordIds

RNG = random.Random(8)
BITS = ["a", " ", "  ", "\n", "é", "don't", " don't", "<|endoftext|>", "x\ty", "\r\n", "12", "!!", "'ll", "漢字", " ", "", "\x00", "A" * (LONGEST + 1), "\u0301", "ﬁ", "😀" * 90, "\u200b", "\x1c"]
TEXTS = ["".join(RNG.choice(BITS) for _ in range(RNG.randint(0, 12))) for _ in range(3000)] + [None, "", " ", "\n"]


@pytest.mark.parametrize("name, joined", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("bits, size", [(16, 1 << 19), (8, 3000), (4, 40)])
def test_ids_are_the_library_s(name, joined, bits, size):
    words = WordIds(public_tokenizers.path(name), joined, bits)
    want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch_fast([t or "" for t in TEXTS], add_special_tokens=False)]
    for _ in range(2):
        assert [i for part in chunks(TEXTS, size) for i in words.encode(part)] == want


def test_sections_are_cut_at_special_tokens_in_one_pass():
    pieces = bpe.Pieces(public_tokenizers.path("word_bpe_49k.json"))
    text = "One<|endoftext|>" * 50_000 + "end"
    found = list(pieces.sections(text))
    assert len(found) == 100_001 and found[:2] == [("one", -1), ("", 49407)] and found[-1] == ("end", -1)
