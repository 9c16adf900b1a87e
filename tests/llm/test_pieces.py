"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cipherledger.llm import pieces, registry

PATH = public_tokenizers.path("piece_bpe_32k.model")
CASES = [None, "", " ", "  a", "a  b ", "\ta\n\n b", "▁x", " ▁ y", "a\x00b", "😀 x", "ｗide", "</s><s>", "<0x41>", "⁇", "é" * 300, "x" * 3000, "ab " * 20_000, "梦 ң ла", "​", "a\r\nb"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.MergeVocabulary(pieces.model_bytes(PATH))


def test_random_texts(vocabulary):
    rng = random.Random(1)
    texts = ["".join(rng.choice(" ▁abE\n\t​é😀梦th<0x41>ａq") for _ in range(rng.randrange(60))) for _ in range(5000)]
    flat, offsets = vocabulary.encode_batch(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == vocabulary.library.encode(texts)


def test_matrix_and_heap_agree(vocabulary):
    rng = random.Random(2)
    cuts = ["▁" + "".join(rng.choice("theandrsti") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    rows = vocabulary.merge_rows(cuts)
    assert all(np.frombuffer(rows[c], np.int32).tolist() == vocabulary.encode_cut(c) for c in cuts)


def test_random_ids_decode_like_the_library(vocabulary):
    rng = random.Random(3)
    ids = [[rng.choice([0, 1, 2, *range(3, 259), 259, 300, 29871]) for _ in range(rng.randrange(9))] for _ in range(5000)]
    assert [vocabulary.decode(np.array(x, np.int32)) for x in ids] == vocabulary.library.decode(ids)


def test_a_wrong_cut_is_noticed(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.check({"▁the": np.array([5], np.int32).tobytes()})


def test_tables_with_defined_cases(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame(list(enumerate(CASES + CASES[3:6])), "doc_id int, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(df, PATH), PATH).collect()}
    for i, t in enumerate(CASES):
        assert got[i].ids == library.encode(t or "") and got[i].decoded == library.decode(got[i].ids)
    assert pieces.digests(df.limit(0), PATH).collect() == []


def test_query_on_whole_table(spark):
    sf, library = "/root/testdata/sf0.001", sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in registry.QUERIES["op4_merge_pieces"](spark, sf).collect()}
    docs = registry.table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
