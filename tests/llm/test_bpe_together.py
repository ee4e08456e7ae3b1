"""Short pre-tokens of a slice are read together, as each by itself would be."""

import random

import numpy as np
import pytest

from millrace.llm import bpe, registry


@pytest.fixture(scope="module")
def codec():
    with open(registry.tokenizer_path(), "rb") as f:
        return bpe.Codec(f.read())


def test_short_as_piece(codec):
    rng = random.Random(4)
    parts = ["the", "tion", "an", "ing", "er", "é", "ß", "你", "1", "'", "\x00", " ", "Qu", "zz"]
    raws = ["".join(rng.choices(parts, k=rng.randint(1, 9))).encode() for _ in range(3000)]
    raws += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert codec.short(raws) == [np.array(codec.piece(x), np.int32).tobytes() for x in raws]
    assert codec.short([]) == []


def test_displaced_values_are_made_again():
    slots = bpe.Slots(lambda k: k * 3, 2, np.int64)
    keys = np.array([*range(50), *range(50)], np.int64)
    for _ in range(3):
        assert slots[keys].tolist() == (keys * 3).tolist()


def test_new_words_are_read_together(codec, monkeypatch):
    """Word by word, the new words of check_l took more CPU time than the budget has."""
    rng = random.Random(5)
    words = ["".join(rng.choices(["thr", "ontio", "ea", "wh", "ndst", "ly"], k=4)) for _ in range(2000)]
    texts = [" ".join(words[at : at + 100]) + ". \n\nx" + "".join(words[at : at + 30]) for at in range(0, 2000, 100)]
    read, own = [], codec.piece
    monkeypatch.setattr(codec, "piece", lambda raw: read.append(len(raw)) or own(raw))
    packed = codec.encode_all([None, "", *texts])
    assert packed[:2] == [b"", b""] and codec.decode_all(packed) == ["", "", *texts]
    assert len(read) == 20 and min(read) > bpe.CACHE_BYTES
    assert packed == [codec.encode(t or "") for t in [None, "", *texts]]


def test_equal_to_library(codec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(6)
    parts = ["a", "Word", "don't", "'s", ".", ",", "!?", " ", "  ", "\n", "\t", " ", "naïve", "漢字", "12", "<|endoftext|>", "é", "x" * 60]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)]
    got = codec.encode_all(texts)
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, np.int32).tobytes() for t in texts]
