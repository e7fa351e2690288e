import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factsheet.llm import byte_bpe

PATH = P.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(library, texts):
    codec = byte_bpe.codec(PATH)
    for text, (ids, offsets) in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:80]
        assert codec.decode(ids, offsets) == text.encode()
        assert offsets.tolist() == np.cumsum([0, *[len(codec.bytes[i]) for i in ids]]).tolist()[:-1]


ODD = ["", "'", " ", "  a", "'s", "a's", "''s", " 's", "\n's", "'re'll've", "'really", "a" * 5000, " " * 3000 + "x", "!" * 2000, "<|endoftext|>", "\u00a0x\u2003y", "١٢ ³", "é\u0301", "a\n\n b\r\n  c "]


def test_odd_texts(library):
    check(library, ODD)


def test_long_text(library):
    rng = random.Random(3)
    check(library, ["".join(rng.choice("abc '\n!7é") for _ in range(200_000))])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab'srevltmd \n\t1!?é世"), st.characters(exclude_categories=["Cs", "Cn"]))), max_size=6))
def test_same_ids_as_the_library(library, texts):
    check(library, texts)


def test_boundaries_are_those_of_the_pattern():
    text = "It's  they'll\tgo 12x !'s"
    points = np.frombuffer(("\n" + text + "\n").encode("utf-32-le"), "<u4")
    begun = np.flatnonzero(byte_bpe.starts(points, np.array([0, len(text) + 1])))
    assert begun[1:-1].tolist() == [m.start() + 1 for m in regex.finditer(P.PATTERN, text)]


def test_null_repeated_and_extra_columns(spark, library):
    df = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (1, "a b", 6), (None, "", 7)], "doc_id long, text string, n_tokens int")
    rows = byte_bpe.digests(df).orderBy(F.col("doc_id").isNull(), "n_tokens").collect()
    assert [r.n_tokens for r in rows] == [0, 2, 2, 0]
    assert rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[1].ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary("a b"), "<u4").tobytes()).hexdigest()
    assert byte_bpe.digests(df.limit(0)).count() == 0
    whole = byte_bpe.encoded(df).orderBy("n_tokens").collect()
    assert whole[-1].ids == library.encode_ordinary("a b") and whole[-1].offsets == [0, 1]
