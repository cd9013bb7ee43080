import base64
import random

import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import bytebpe
from tests.llm import brute

LETTERS = "abc  \n\t'sstTE0129é漢字ñ😀‍́\x1c\x1f\x85\xa0 　﻿▁ĀǿⅣ½٣.,!?-_#"


def plain(name):
    with open(public_tokenizers.path(name), "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n=400):
    r = random.Random(seed)
    words = ["the", " tokenizers", "It's", " we'll", " 12345", "\n\n", "   ", "don't", "ñandú", "<|endoftext|>", "====", " antidisestablishmentarianism", "\x00", "\r\n"]
    out = ["", " ", "\n", "a" * 3000, " " * 500 + "x", "1" * 400, "é" * 300, "▁▁", "".join(chr(k) for k in range(1, 0x250))]
    for _ in range(n):
        out.append("".join(r.choice(words) if r.random() < 0.4 else r.choice(LETTERS) for _ in range(r.randrange(80))))
        out.append("".join(chr(k) for k in (r.randrange(0x110000) for _ in range(20)) if not 0xD800 <= k < 0xE000))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_same_as_plain_and_round_trip(name):
    tokens = bytebpe.read_ranks(public_tokenizers.path(name))
    c, want = bytebpe.Coder(tokens, bytebpe.model_of(tokens), public_tokenizers.PATTERN), plain(name)
    for text in texts(1):
        ids = [k for block in c.blocks(text) for k in block]
        assert ids == want.encode_ordinary(text), text
        assert c.decode(ids) == text.encode()
        assert c.digests(text) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))


def test_long_texts_and_memory(monkeypatch):
    tokens = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(bytebpe, "WHOLE_TEXT", 20)
    monkeypatch.setattr(bytebpe, "CUTS", 3)
    monkeypatch.setattr(bytebpe, "REMEMBERED", 5)
    c, want = bytebpe.Coder(tokens, bytebpe.model_of(tokens), public_tokenizers.PATTERN), plain("byte_bpe_50k.tiktoken")
    for text in texts(2, 60):
        ids = want.encode_ordinary(text)
        assert c.digests(text) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))
        assert len(c.memory) <= 5


def test_table(spark):
    made = texts(3, 100) + [None, "same", "same"]
    df = spark.createDataFrame([(k, t, "clash", [9]) for k, t in enumerate(made)], "doc_id long, text string, _e_n string, ids array<int>").repartition(3)
    out = bytebpe.with_bytes(bytebpe.with_ids(df, digests=True)).collect()
    want = plain("byte_bpe_50k.tiktoken")
    assert len(out) == len(made)
    for row in out:
        text = made[row.doc_id]
        if text is None:
            assert row["_e_ids"] is row["_e_bytes"] is row["_e_n"] is row["_e_ids_sha256"] is None
        else:
            assert row["_e_ids"] == want.encode_ordinary(text) and bytes(row["_e_bytes"]) == text.encode() and row["_e_n"] == len(row["_e_ids"]) and row["_e_bytes_sha256"] == brute.sha(text)
    assert bytebpe.with_ids(df.limit(0), digests=True).count() == 0


def test_missing_bytes_are_an_error(tmp_path):
    (tmp_path / "ranks").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="bytes without a token"):
        bytebpe.read_ranks(str(tmp_path / "ranks"))
