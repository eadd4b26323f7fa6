"""Token counts and packing against the tokenizer library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trailmix.llm import packing, token_counts

TEXTS = [
    "Hello there, it's 1234 times  two\n\n  spaces\t end ", "", None, "a", "<|endoftext|>mid<|endoftext|>", "x" * 5000, "été über ñandú " * 50,
    " lead\n line", "　wide  space  x", "\U00010940՘ rare letters ࢏1", "same", "same", "word " * 4000, "\r\n \r\n a  b   c", "don't we'll I'M",
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("length", T.StringType())])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", None) for i, t in enumerate(texts)], SCHEMA)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, library):
    got = token_counts.token_counts(frame(spark), P.path("byte_bpe_50k.json"), P.PATTERN, limit=100).collect()
    want = sorted((len((t or "").encode()), len(expected(library, t)), len(expected(library, t)) > 100) for t in TEXTS)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_counts_on_sample_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: len(expected(library, r.text)) for r in docs.collect()}


def test_heap_merging_takes_the_lowest_rank_leftmost():
    merges = {(1, 1): (0, 2), (2, 2): (1, 3), (2, 1): (2, 4)}
    assert token_counts.merged_length([1, 1, 1], merges) == 1
    assert token_counts.merged_length([1] * 5, merges) == 2
    assert token_counts.merged_length([], merges) == 0


def pieces_hold(rows, texts_by_doc, library, limit):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, parts in docs.items():
        ids = [*expected(library, texts_by_doc[doc]), 0]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(docs) == set(texts_by_doc)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == limit or at & (at - 1) == 0 and at < limit


@pytest.mark.parametrize("window", [1, 500, 1 << 20])
def test_packing_is_a_partition_without_padding(spark, library, window):
    rows = packing.pack(frame(spark), P.path("byte_bpe_50k.json"), P.PATTERN, window_tokens=window, with_ids=True).collect()
    pieces_hold(rows, {(i if i != 3 else None): t for i, t in enumerate(TEXTS)}, library, 1024)
    assert all(len(r.ids) == r.length for r in rows)


def test_packing_of_sample_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    pieces_hold(packing.query(spark, "/root/testdata/sf0.001").collect(), docs, library, 1024)


def test_empty_tables(spark):
    none = frame(spark).where("doc_id < 0")
    assert packing.pack(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_costs_are_even():
    placed = packing.balanced([900, 500, 500, 100, 48], 1024, 1.0, 1 / 1024)
    assert {(p[0], p[3]) for p in placed if p[2] == 500} in ({(1, 1), (2, 1)}, {(1, 0), (2, 0)})
    assert sum(p[2] for p in placed) == 2048
