import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyroom.llm import bpe
from tallyroom.llm.bpe import WordBpe, encoded

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    with open(PATH, encoding="utf-8") as f:
        return WordBpe(f.read()), library


TEXTS = [
    "", " ", "Hello, World's it'll 1234 <|endoftext|>x", "ÉCOLE Straße İSTANBUL ΟΔΟΣ ﬁne é", "a" * 300, "日本語テキスト 🤖🤖!!",
    "x\x1cy\x85z　w", "antidisestablishmentarianism thndonndon erly\ttab\n\n#%&*", "<|startoftext|><|endoftext|> <|end", "\x00\x01",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_text_as_the_library(both, text):
    own, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcdeinorst'ABC 19é", max_size=80)))
def test_any_text(both, text):
    own, library = both
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("before,after", [("", " "), ("ab", "cd "), (":", "a "), ("a\u0301", "\u0316 ")])
def test_every_code_point(both, before, after):
    """All of them, alone, inside a word, after a sign, and between combining marks."""
    own, library = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        text = "".join(before + chr(c) + after for c in points[i : i + 20_000])
        if own.encode(text).tolist() != library.encode(text, add_special_tokens=False).ids:
            for c in points[i : i + 20_000]:
                text = before + chr(c) + after
                assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_pieces_are_forgotten(both):
    own, _ = both
    own.encode("some words that are remembered, and 日本語")
    assert own._known and own._fits
    own.forget()
    assert not own._known and not own._known.old and not own._fits


def test_generations_of_pieces(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "SLICE", 2)
    text = "one two three one four five six one two <|endoftext|> seven one"
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids and len(own._known) <= 5


def test_rows(spark, both):
    rows = [(1, "Hello there", "en"), (2, None, "fr"), (2, "", "x"), (3, "word " * 5000, None)]
    got = sorted(encoded(spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string"), PATH).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2), (2, 0), (2, 0), (3, 5000)]
    assert got[1].ids_sha256 == got[1].decoded_sha256 == empty
    assert encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
