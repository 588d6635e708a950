"""Words that go right to the library's model give the library's ids, and only other pieces go through its split."""

from __future__ import annotations

import random

import pytest

from deltaloom.llm import pieces

ODD = ["", " ", "\n", "Word### two&&& three%%%,*** ÉCOLE### straße$$$", "a'll#s b's% ²## x²%% ǅ## İ** ÿŸ", "<|endoftext|>## <|ENDOFTEXT|> x<|startoftext|>###", "éa## Å&& ªº%% ×÷ a×b", "z" * 63 + "### " + "z" * 64 + " " + "z" * 65 + " " + "é" * 300, "ab\0cd ef\0", "\n\nThe\n end#", "İ. \u0958, x\u0958### " + "x" * 300 + "İ.a\u0958!b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_equal_the_library(name):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(pieces.LETTERS, k=rng.randint(1, 12)))
    texts = [" ".join(word() + rng.choice(["", "", ".", "###", "%%%,***", "'s", "9"]) for _ in range(200)) for _ in range(50)] + ODD
    want = [e.ids for e in pieces.load(name).encode_batch_fast(texts, add_special_tokens=False)]
    pieces._encoders.clear()
    for _ in range(2):
        assert [len(x) for x in want] == pieces.counter(name).values(texts)
        got = pieces.ids(name).values(texts)
        width = int(pieces.id_kind(name)[-1])
        assert [[int.from_bytes(g[i : i + width], "little") for i in range(0, len(g), width)] for g in got] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_skip_the_split(name):
    enc, seen = pieces.Encoder(name, len, int.__add__, sum), []
    old = enc._encode
    enc._encode = lambda batch: (seen.extend(batch), old(batch))
    enc.values(["Quevile tionéelle straße### zuwort,%%% ende.", "12 quevile"])
    assert sorted(p.strip() for p in seen) == ["###", ",%%%", ".", "12"]
