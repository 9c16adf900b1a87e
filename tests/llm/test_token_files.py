"""Token files against the library, over the coding's edges and the whole table."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cipherledger.llm import registry, token_files, word_ids
from cipherledger.session import stage_folder

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def wanted(rows):
    """(key, start, n_tokens, crc) of rows in key order, each encoded whole."""
    library, out, at = Tokenizer.from_file(WORDS), [], 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_codes_of_all_widths():
    rng = np.random.default_rng(1)
    ranks = np.r_[0, 255, 256, 65535, 65536, 2 ** 24 - 1, 2 ** 24, 2 ** 32 - 1, rng.integers(0, 2 ** 32, 996, dtype=np.uint64) >> rng.integers(0, 32, 996, dtype=np.uint64)].astype(np.uint32)
    control, data = token_files.code(ranks)
    assert len(control) == len(ranks) // 4
    assert (token_files.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)) == ranks).all()


def test_registered_query_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(registry.QUERIES["op11_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert [tuple(r) for r in got] == wanted([(r.doc_id, r.text) for r in docs])


def test_defined_cases(spark):
    odd = ["", None, "  \n\t ", "Ünïcode éa b İstanbul ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "don't we'll 12,345 á́", "word " * 30_000,
           "w" * 5_000, "한국어 가 ́start", "　全角　空白\x85\x1c\x1f end"]
    rows = [(k - 3, t) for k, t in enumerate(odd)]
    repeated = [(50, "the same text")] * 400
    df = spark.createDataFrame([(k, t, "x", 1.5) for k, t in [*rows, *repeated, (None, "no key")]], "doc_id long, text string, id string, turn double")
    folder = stage_folder(spark, "token-files")
    manifest = token_files.write_files(df, folder, WORDS, 2, file_ids=300, range_rows=40)
    assert manifest.count() > 5
    got = sorted((tuple(r) for r in token_files.read_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == wanted([(None, "no key"), *rows, *repeated])

    empty = stage_folder(spark, "token-files")
    assert token_files.write_files(df.limit(0), empty, WORDS, 2).collect() == []
    assert token_files.read_files(spark, empty).collect() == []


def test_files_of_lost_attempts_are_not_read(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    folder = stage_folder(spark, "token-files")
    token_files.write_files(df, folder, WORDS, 2)
    with open(f"{folder}/files/part-0000000-00000-lost.tok", "wb") as f:
        f.write(b"half a file")
    # the lost file is dropped by its name before its bytes are looked at
    assert token_files.read_files(spark, folder).count() == 50


def test_words_are_the_library_s(monkeypatch):
    monkeypatch.setattr(word_ids, "MOST", 300)
    monkeypatch.setattr(word_ids, "LOT", 400)
    with open(WORDS, encoding="utf-8") as f:
        encoder = word_ids.Encoder(f.read(), 2, True)
    library, rng = Tokenizer.from_file(WORDS), random.Random(3)
    assert encoder.direct
    plain = ["a", "Re", "s", "don", "'", "'", "'S", "ve", "'ll", "l", "É", "Ünd", "ÿ", ",", "!", "0", "17", ".", "-", "<", "|>", "\n", " ", "\t", "word", "x" * 70, "x" * 71]
    odd = ["<|", "e\u0301", "\u0301", "\u0130", "\u2019", "\u00a0", "\u2003", "\u4e2d", "\u0663", "endoftext", "\x00", "\u200d", "×", "÷", "\x0b", "µ", "ß"]
    texts = ["".join(rng.choice(plain if k % 2 else plain + odd) for _ in range(rng.randrange(0, 16))) for k in range(6000)]
    texts += [" ".join(rng.choice(plain) for _ in range(900)), "y" * 2000, "", None]
    for s in range(0, len(texts), 50):
        for text, ids in zip(texts[s:s + 50], encoder.encode(texts[s:s + 50])):
            assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], repr(text)
