"""Long single words: cut where no token reaches across, contracted in turns; equal to the tokenizer library."""

from __future__ import annotations

import base64
import random
import resource
import string
import sys
import time

import numpy as np
import pytest
import tiktoken

sys.path.insert(0, "/opt/tokenizers")
import public_tokenizers  # noqa: E402

from latticework.llm import bpe  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codecs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return bpe.Codec(RANKS, public_tokenizers.PATTERN), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(codecs, text):
    ours, theirs = codecs
    return np.frombuffer(ours.encode([text])[0], "<u2").tolist() == theirs.encode(text, disallowed_special=())


def test_a_word_of_100_000_letters(codecs):
    word = "".join(random.Random(1).choices(string.ascii_lowercase, k=100_000))
    start = time.monotonic()
    assert same(codecs, word)
    assert time.monotonic() - start < 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20  # 1 GB


@pytest.mark.parametrize("letters", [["a"], list("acgt"), list("abtehi"), ["tion", "er", "in", "the", "an", "re", "on", "at"], list("é漢字kxq"), list("=-_"), ["ab", "ba", "aba"]])
@pytest.mark.parametrize("n", [40, 300, 5000])
def test_words_that_are_not_cut(codecs, letters, n):
    """Few letters, common syllables, ties of overlapping pairs, and more turns than one query holds."""
    assert same(codecs, "".join(random.Random(n).choices(letters, k=n)))


def test_many_words_at_once(codecs):
    rng = random.Random(7)
    words = ["".join(rng.choices("aeinrst", k=rng.randrange(60, 200))) for _ in range(400)]
    assert same(codecs, " ".join(words + words[:50]))


def test_no_merge_crosses_a_cut(codecs):
    c, _ = codecs
    word = "".join(random.Random(3).choices(string.ascii_letters, k=3000)).encode()
    parts = c.parted(word)
    assert b"".join(parts) == word and len(parts) > 1
    pairs = {a[-1:] + b[:1] for a, b in zip(parts, parts[1:])}
    assert not any(p in t for p in pairs for t in c.tokens)
