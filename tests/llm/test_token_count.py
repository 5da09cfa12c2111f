from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fringeflow.llm.token_count import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a \n\n b\t", "<|endoftext|>x<|endoftext|>", "a" * 3000, "I'll 'S 's12", "\x1c\x85\xa0x \u3000y", "日本 🎉 é e\u0301", "ab" * 40]


def test_counts_equal_the_library(make_docs, awkward):
    rnd = random.Random(2)
    rows = awkward + list(enumerate(ODD, 200))
    rows += [(300 + i, "".join(rnd.choice("aeinrt 'l.\n1é") for _ in range(rnd.randrange(80)))) for i in range(300)]
    rows += [(700 + i, "".join(chr(rnd.randrange(1, 0x2FFF)) for _ in range(40))) for i in range(60)]
    got = count_tokens(make_docs(rows), PATH, 30).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 30))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(make_docs):
    assert count_tokens(make_docs([]), PATH, 30).collect() == []


def test_other_kinds_of_tokenizers_are_refused(make_docs):
    with pytest.raises(Exception, match="not a plain byte-level BPE"):
        count_tokens(make_docs([(1, "a")]), public_tokenizers.path("word_bpe_49k.json"), 30).collect()
