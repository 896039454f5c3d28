import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleloom.llm import bpe, tokenise

pytestmark = pytest.mark.skipif(not os.path.exists(tokenise.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(tokenise.VOCABULARY)


@pytest.fixture(scope="module")
def machine(vocabulary):
    return bpe.Transducer(vocabulary)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenise.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encode(machine, texts):
    ids, counts = zip(*machine.encode_texts(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(np.concatenate(ids), np.cumsum(np.concatenate(counts))[:-1])]


PIECES = ["a", "the", "'", "'s", "'ll", "re", " ", "  ", "\n", "\t", "\r\n", " ", "　", "é", "ß", "中文", "1", "½", "٣", "🙂", "👩‍🔧", "!", "...", "_", "<|endoftext|>", "\x1c", "​", "﻿", "Xy", "́", "\x00"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Co", "Cs"]), max_size=40)), min_size=1, max_size=8))
def test_ids_are_the_librarys(machine, library, texts):
    assert encode(machine, texts) == library(texts)


def test_long_words_and_long_texts(machine, library, monkeypatch):
    texts = ["a" * 30_000, "ab" * 9_000 + " x", "=" * 20_001, " " * 9_000 + "x", "\n" * 70, "it's " * 4000, "x" * 3 + "é" * 20_000]
    want = library(texts)
    assert encode(machine, texts) == want
    monkeypatch.setattr(bpe, "PIECE_BYTES", 1000)
    assert encode(machine, texts) == want
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 10)
    fresh = bpe.Transducer(bpe.Vocabulary(machine.tokens, machine.left, machine.right, machine.classes.tobytes()))
    assert encode(fresh, texts) == want


def test_neighbours_that_merges_cross(machine):
    the = machine.ids[b"the"]
    assert machine.boundary(the, machine.ids[b" the"])
    assert not machine.boundary(machine.ids[b"t"], machine.ids[b"he"])


def test_tables(spark, library):
    texts = [(1, "Hello world's\n", "x"), (2, "", "x"), (3, None, "x"), (4, "é中🙂 �", "x"), (4, "same id", "x"), (5, "<|endoftext|>", "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, ids string")
    rows = tokenise.encode(df, ["doc_id"])
    assert rows.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert sorted((r.doc_id, r.ids) for r in rows.collect()) == sorted((i, library([t or ""])[0]) for i, t, _ in texts)
    assert sorted((r.doc_id, r.tokens) for r in tokenise.count(df, ["doc_id"]).collect()) == sorted((i, len(library([t or ""])[0])) for i, t, _ in texts)
    assert sorted((r.doc_id, r.text) for r in tokenise.decode(rows, ["doc_id"]).collect()) == sorted((i, t or "") for i, t, _ in texts)
    assert tokenise.encode(df.where("doc_id < 0"), ["doc_id"]).count() == 0


def test_streaming_decode(vocabulary, machine):
    ids = machine.encode("é🙂".encode())
    for step in (1, 2, 5):
        assert "".join(bpe.decode_stream(vocabulary.tokens, ids, step)) == "é🙂"
    assert "".join(bpe.decode_stream(vocabulary.tokens, ids[:-1], 1)).endswith("�")
    assert "".join(bpe.decode_stream(vocabulary.tokens, [])) == ""
