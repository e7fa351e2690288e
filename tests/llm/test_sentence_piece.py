import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factsheet.llm import queries, sentence_piece

PATH = P.path(sentence_piece.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(library, texts):
    own = list(sentence_piece.pieces(PATH).encode(texts))
    assert [x.tolist() for x in own] == library.encode(texts, add_bos=True, add_eos=True)


def test_odd_texts(library):
    check(library, ["", " ", "  a  b ", "a\tb\nc", "▁x ▁", "Ａé é ﬁ", "\x00a", "<s>hi</s><0x41><unk>", "\r\n" * 10, "😀 👩‍👩‍👧", "​﻿", "漢字かな交じり文" * 50, "\U00020000\U0010ffff"])


def test_long_slices(library):
    rng = random.Random(5)
    check(library, ["a" * 5000, "ab" * 3000 + " x", " " * 3000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "".join(rng.choice("ab é世\n7") for _ in range(200_000))])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abestinrou ▁\n\t17é世"), st.characters(exclude_categories=["Cs", "Cn"]))), max_size=6))
def test_same_ids_as_the_library(library, texts):
    check(library, texts)


def test_heads_together_give_what_one_agenda_gives():
    rng = random.Random(2)
    model = sentence_piece.pieces(PATH)
    slices = ["".join(rng.choices("thearinsoﬁ漢\x01 ▁", k=rng.randrange(1, 40))) for _ in range(3000)]
    made = list(model.merged_together(slices))
    assert sorted(s for s, _ in made) == sorted(slices)
    assert all(model.merged(s) == ids for s, ids in made)


def test_a_full_cache_begins_anew(library):
    rng = random.Random(4)
    model = sentence_piece.Pieces(PATH, cache=50)
    texts = [" ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 7))) for _ in range(40)) for _ in range(30)]
    made = [x.tolist() for t in texts for x in model.encode([t])]
    assert made == library.encode(texts, add_bos=True, add_eos=True) and len(model.known) <= 90


def test_null_empty_repeated_and_extra_columns(spark, library):
    df = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (1, "a b", 6), (None, "", 7)], "doc_id long, text string, N_TOKENS int")
    rows = sentence_piece.digests(df).orderBy(F.col("doc_id").isNull(), "n_tokens").collect()
    ids = library.encode("a b", add_bos=True, add_eos=True)
    assert [r.n_tokens for r in rows] == [2, len(ids), len(ids), 2]
    assert rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert rows[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert sentence_piece.digests(df.limit(0)).count() == 0
    whole = sentence_piece.decoded(sentence_piece.encoded(df)).orderBy("n_tokens").collect()
    assert [r.decoded for r in whole] == ["", "", "a b", "a b"] and whole[-1].ids == ids


def test_whole_table_against_the_library(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sentence_piece.differences(documents).count() == 0
    found = queries.QUERIES["op13_sentence_piece"](spark, "/root/testdata/sf0.01").toPandas()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = documents.select("doc_id", "text").toPandas()
    by_id = found.set_index("doc_id")
    assert len(found) == len(texts)
    for doc_id, text in zip(texts["doc_id"], texts["text"]):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = by_id.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
