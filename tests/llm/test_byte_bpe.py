"""Byte-level BPE in overlapping chunks against the library on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ferrule.llm import byte_bpe
from ferrule.llm.queries import QUERIES

DOCS = "doc_id long, text string, ids string, key string"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def nasty(rng, n):
    """Text of runs, contractions, scripts, marks, and letters on which versions of Unicode differ."""
    pieces = ["'re", "'s", "'", "'l", "l", " ", "  ", "\n", "\n\n", "\t", " ", "\x1c", "a", "word", "Zebra", "1", "23", "²", "é", "漢字", "𝒳", "՘", "࢏", "\U0003134f", "!", "?!", "́", "<|endoftext|>", "can't", "x" * 9, " " * 9]
    return "".join(rng.choice(pieces) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], DOCS)


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 8), (40, 40), (64, 6)])
def test_chunks_give_the_ids_of_the_whole_text(spark, vocabulary, library, chunk, overlap):
    rng = random.Random(chunk)
    rows = [(k, nasty(rng, rng.choice([0, 1, 5, 30, 200]))) for k in range(120)]
    rows += [(200, None), (None, None), (201, ""), (202, "a" * 500), (203, " " * 500), (204, "x " * 300), (205, "漢" * 300 + "!"), (206, "\n \n" * 100 + "y")]
    rows += [(7, rows[7][1]), (300, "ab'll" * 60), (300, "ab'll" * 60), (301, "ab'll" * 60), (None, "ab'll" * 60), (None, "ab'll" * 60)]
    found = byte_bpe.encode(docs_of(spark, rows).repartition(3), vocabulary, chunk, overlap).collect()
    expected = Counter((d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for d, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == expected


def test_texts_that_meet_are_cut_into_pieces_and_others_are_not(vocabulary):
    codec = byte_bpe.Codec(vocabulary)
    assert list(codec.ends("It's we'll a  b\n\nc d", True)) == [2, 4, 7, 10, 12, 15, 18]
    assert list(codec.ends("we'r", False)) == [2] and list(codec.ends("we'rx", False)) == [2, 3]  # of the first, 're could follow
    assert list(codec.ends("aaa " + "b" * 99, False)) == [3]
    disputed = codec._plain
    assert all(byte_bpe.Codec(vocabulary).encoding.decode_bytes(codec.encode(chr(c)).tolist()) == chr(c).encode() for c in list(disputed)[:50])


def test_long_white_space_is_encoded_where_the_library_gives_up(vocabulary, library):
    codec = byte_bpe.Codec(vocabulary)
    for text in ("a" + " " * 20_000 + "b", " " * 20_000, "a" + "\n" * 20_000 + "'s", "x" * 30 + " \n" * 8_000 + " y  z" + " " * 12_000):
        assert codec.encode(text).tolist() == library.encode_ordinary(text)
    long = "a" + " " * 1_000_000 + "b c"
    assert codec.decode(codec.encode(long)) == long.encode()


def test_decoding_is_an_exact_round_trip(spark, vocabulary):
    rng = random.Random(9)
    rows = [(k, nasty(rng, 100)) for k in range(20)] + [(20, None), (21, "x" * 70_000)]
    encoded = byte_bpe.encode(docs_of(spark, rows), vocabulary).withColumn("decoded", F.lit("clash")).withColumn("n", F.lit(1))
    encoded = encoded.unionByName(spark.createDataFrame([(99, None, "", 1)], "doc_id long, ids binary, decoded string, n int"))
    found = byte_bpe.decode(encoded, vocabulary)
    assert found.columns == ["doc_id", "ids", "n", "decoded"]
    texts = dict(rows)
    assert {r.doc_id: r.decoded if r.doc_id == 99 else bytes(r.decoded) for r in found.collect()} == {d: (t or "").encode() for d, t in texts.items()} | {99: None}
    assert byte_bpe.encode(docs_of(spark, rows).where("false"), vocabulary).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        byte_bpe.encode(docs_of(spark, rows), vocabulary, 10, 20)


def test_the_query_has_the_digests_of_the_library(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = QUERIES["op12_byte_bpe"](spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
