"""Token ids against the tokenizer library's own."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmask.llm.queries import tokenizer_path
from quillmask.llm.tokens import encoder


@pytest.fixture(scope="module")
def both():
    return encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


def agree(both, texts):
    mine, library = both
    for text, ids in zip(texts, mine.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_the_encoder_is_used_and_not_the_fallback(both):
    assert both[0].exact


@pytest.mark.parametrize("letters", ["aAbzéÉßñÑ'stmrevld 0123²½ªµ.,!#<|>\n\t\x0b\x0c\r\x85\xa0\x00\x1f\x1c\xad°±œ—“日本語İıΣς́ 　🙂", "abcdeéstrn' .,1", "".join(map(chr, range(0x130)))])
def test_random_texts(both, letters):
    r = random.Random(7)
    agree(both, ["".join(r.choices(letters, k=r.randrange(120))) for _ in range(2000)])


@pytest.mark.parametrize("texts", [[""], [" "], ["", "a", ""], ["日本"], ["a" * 50_000], ["ab, c " * 20_000], ["x <|endoftext|> y"], ["same words", "same words"]])
def test_edges(both, texts):
    agree(both, texts)


def test_no_texts(both):
    assert both[0].encode([]) == [] and isinstance(both[0].encode([b"a"])[0], np.ndarray)
