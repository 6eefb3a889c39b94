"""Units that a full cache holds are found without a call of Python for each."""

import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm import tokens

WHITE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_full_cache(name):
    path = public_tokenizers.path(name)
    held, whole = tokens.CachedTokenizer(path), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    many = " ".join(["alpha", "beta", "gamma", "delta"] * 1000)
    held.encode([many])
    held.cache_bytes = held.held_bytes  # full
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        got = held.encode([f"{many} zyxwv"])
    finally:
        sys.setprofile(None)
    assert calls < 500
    more = [f"{many} zyxwv", "zyxwv zyxwv", *(f"a{c}b {c}zyxwv{c} qponm" for c in WHITE), *(f"a{c}{d}b" for c in " \n" for d in " \n"), " a", "a ", "\na", "a\n", "", " "]
    assert got + held.encode(more[1:]) == [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in whole.encode_batch(more, add_special_tokens=False)]
    assert "zyxwv" not in held.cache and not held.cache.new
