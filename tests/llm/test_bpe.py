import base64
import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st

from skeinflow.llm.bpe import encode, encode_documents, encoder, read_ranks

RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENC = encoder(RANKS, public_tokenizers.PATTERN)


@hyp(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n\t'sé!？世 　ré'll_-", max_size=200), st.integers(1, 20))
def test_cuts_are_safe(text, span):
    assert encode(ENC, text, span) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("white", [" ", "\t", "\n", " \n", "\u3000"])
@pytest.mark.parametrize("after", ["", "word", "\nword", "!x"])
def test_white_space_runs_of_any_length(white, after):
    # what the library does with runs that it can match is the measure for longer ones
    for before in ("", "a1!"):
        text = before + white * (20_000 // len(white)) + after
        assert encode(ENC, text, 10) == ENC.encode_ordinary(text)
    long = "a b " + white * (1_000_000 // len(white)) + after
    ids = encode(ENC, long)
    assert ENC.decode_bytes(ids) == long.encode()


def test_other_patterns_are_never_cut():
    enc = encoder(RANKS, r"\S+|\s")
    assert encode(enc, "ab1 " * 100, 3) == enc.encode_ordinary("ab1 " * 100)


def test_a_pattern_that_only_ends_alike_is_not_cut():
    tokens = [bytes([i]) for i in range(256)] + [b"!\n"]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    enc = encoder(ranks, r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+")
    assert encode(enc, "!\n" * 40_000) == [256] * 40_000


def test_letters_of_newer_tables_are_not_cut_from_others():
    text = "".join(chr(c) for c in range(0x1E000, 0x32400)) * 2 + "x"
    assert encode(ENC, text, 50) == ENC.encode_ordinary(text)


def test_documents(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "<|endoftext|> plain", "x" * 120_000, " " * 60_000 + "y", " " * 1_000_000 + "y", "\n" * 1_000_000, "".join(rng.choice("ab '1é\n") for _ in range(200_000)), "same", "same"]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.row_id: r for r in encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = ENC.encode_ordinary(text or "") if len(text or "") < 1_000_000 else encode(ENC, text)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (text or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_documents(df, RANKS, public_tokenizers.PATTERN, keep_decoded=False).columns[-1] == "ids"
    assert encode_documents(df.filter("false"), RANKS, public_tokenizers.PATTERN).collect() == []


def test_missing_rank_file():
    with pytest.raises(FileNotFoundError):
        read_ranks("/nonexistent.tiktoken")
