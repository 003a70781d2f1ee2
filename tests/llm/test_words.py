"""The encoder's cuts in bytes, against the library's own call."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lamina.llm import tokens

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SIGNS = [*"abzABZ09éßÿÀÞ×÷ªµ漢Σİ", *".,!?;:'#-<|>$", *"    \n\t\r\x0b\x1c\x85\xa0 　̸́;\x00", "'s", "'LL", "the ", "<|", "\U0001f600"]


def library(path, texts):
    engine = Tokenizer.from_file(path)
    return [np.array(engine.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


class Counted:
    """A tokenizer that counts its runs."""

    def __init__(self, engine):
        self.engine, self.runs = engine, 0

    def encode_batch_fast(self, *args, **kw):
        self.runs += 1
        return self.engine.encode_batch_fast(*args, **kw)


def test_found_words_need_no_normaliser(monkeypatch):
    texts = ["The quick brown fox, jumps over.", "größe élan ### it's 42 times\nanother line", "", None]
    worker = tokens.Encoder(WORD_BPE)
    worker.plain = Counted(worker.plain)
    monkeypatch.setitem(tokens._ENCODERS, WORD_BPE, worker)
    assert list(tokens.encoded(pa.array(texts), WORD_BPE)) == library(WORD_BPE, texts)
    assert worker.plain.runs == 0


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_upper_case_mark_is_none(path):
    texts = ["漢<|ENDOFTEXT|> b", "a <|endoftext|> b", "plain"]
    want = library(path, texts)
    assert list(tokens.encoded(pa.array(texts), path)) == want
    assert [next(tokens.encoded(pa.array([t]), path)) for t in texts] == want


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_part_of_a_column(path):
    texts = [f"Some words of text {i}." for i in range(40)]
    whole, want = pa.array(texts, pa.string()), library(path, texts)
    for first in (0, 3, 8, 16):
        assert list(tokens.encoded(whole.slice(first, 20), path)) == want[first : first + 20]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_hostile_signs(path):
    dice = random.Random(7)
    texts = ["".join(dice.choices(SIGNS, k=dice.randrange(14))) for _ in range(3000)]
    texts += [None, "", ".", "a.", ".a", "é.", "×.", "÷;", " ", "\n", "a..b", "x" * 3000]
    want = library(path, texts)
    assert list(tokens.encoded(pa.array(texts), path)) == want
    for first in range(0, 600, 3):
        assert list(tokens.encoded(pa.array(texts[first : first + 3]), path)) == want[first : first + 3]
