"""Cached encoding against the tokenizers library on whole texts."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gapwright.llm.tokens import TextEncoder, encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n", "a\n", "a \n", "it's we'LL I'm", "x,y. z; 'quoted'. a., b.,c", "é, ß: Σας ΣΑΣ ́a é, ñ ậ", "<|endoftext|>", "a  <|endoftext|> b", "<|startoftext|>x", " a  b", "a  b 　c", "a ᠎ b ​ c", "\x1c a \x1d\x1eb \x85 c", "日本語 の テキスト 12345 ½ ²", "😀 a 👩‍👩‍👧 b", "\x00 \x0b\x0c x", "A" * 500, "ab " * 300, "...,,, a.b.c , . ;", "á. ́, b"]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    path = public_tokenizers.path(name)
    own, theirs = encoder(path), Tokenizer.from_file(path)
    for text in ODD + [a + b for a in ODD for b in ODD]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    path = public_tokenizers.path(name)
    own, theirs = encoder(path), Tokenizer.from_file(path)
    some = st.text(st.one_of(st.sampled_from(" \n\t.,;:'aAeés1!-<|> ́​ \x1f"), st.characters(exclude_categories=["Cs"])), max_size=40)

    @settings(max_examples=1500, deadline=None)
    @given(some)
    def same(text):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("name", FILES)
def test_words_of_letters(name):
    path = public_tokenizers.path(name)
    own, theirs = encoder(path), Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = letters + [a + b for a in letters for b in "aéßİ"] + [b + a for a in letters for b in "sÑ"]
    for text in words + [f"x {w}" for w in words]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_with_marks_behind_them(file):
    """A word, its marks and a word on the next line are encoded each by itself, with the ids of the whole text."""
    import random
    from array import array

    enc = TextEncoder(public_tokenizers.path(file))
    whole = lambda text: array("I", enc.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    pick = random.Random(5)
    parts = ["word", "Été", "ª", "²", "x1", "'s", "don't", ".", "!!", "&&&", "\n", "\n\n", " ", "  ", "\t", "日本", "é", "<|", "12", "_", "\r\n", "É\nb"]
    for _ in range(3000):
        text = "".join(pick.choices(parts, k=pick.randint(1, 9)))
        assert enc.encode(text) == whole(text), text
    if enc.kind == "blank":
        asked, plain = [], enc.library
        enc.library = lambda text: asked.append(text) or plain(text)
        word = lambda: "".join(pick.choices("abcdefgß", k=8))
        text = " ".join([f"{word()}&&&" for _ in range(300)] + [f"{word()}.\n{word()}" for _ in range(300)])
        assert enc.encode(text) == whole(text)
        assert len(asked) <= 4, asked[:9]
        assert enc.whole(" abcdefgh") == whole(" abcdefgh") and len(asked) <= 4
