"""Which words are folded once for the corpus, and texts apart at blanks, against the library."""

import base64
import hashlib
import inspect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from trailmix.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
PARTS = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u202f", "\u200b", "\u3000", "'s", "'", "'ll", "a", "the", "Word", "12", "٣", "!", "--", "é", "字", "𝔘", "aaaa", "abab"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_a_quarter_million_recurring_words_are_folded_once(spark):
    counts = spark.range(250_000).select(F.col("id").cast("string").cast("binary").alias("word"), F.lit(2).cast("bigint").alias("n"))
    most = inspect.signature(byte_bpe.encode).parameters["most"].default
    assert byte_bpe.frequent(counts, most).count() == 250_000


@pytest.mark.parametrize("most", [0, 1000])
def test_any_white_space_between_words(spark, library, most):
    draw = random.Random(3)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(1, 12))) for _ in range(1500)]
    texts += ["".join(draw.choices("abcdeinorst", k=draw.randint(1, 40))) + " ab" * draw.randint(0, 2) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, P.PATTERN, most=most, block_chars=2000).collect()}
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != library.encode_ordinary(t)]
    assert len(got) == len(texts) and not wrong, wrong[:3]


def test_another_pattern_is_matched_over_whole_texts(spark):
    pattern = r"a b|[^ ]+| "
    ranks = byte_bpe.read_ranks(byte_bpe.read_small(PATH))
    pieces = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(0, "a b a b c"), (1, " a  b")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, pattern).collect()} == {0: pieces.encode_ordinary("a b a b c"), 1: pieces.encode_ordinary(" a  b")}


def test_words_of_one_bucket_are_told_apart():
    entries = b"".join(len(w).to_bytes(2, "little") + (4).to_bytes(2, "little") + w + i.to_bytes(4, "little") for i, w in enumerate([b" a", b" ab", b"b"]))
    words = byte_bpe.Words(np.array([0, len(entries)], "<u4").tobytes(), entries)
    assert [words.get(w) for w in (b" a", b" ab", b"b", b"a")] == [bytes([i, 0, 0, 0]) for i in range(3)] + [None]


def test_a_vocabulary_beyond_the_packed_ids_is_refused():
    with pytest.raises(ValueError, match="vocabulary"):
        byte_bpe.rank_map({(1, 2): byte_bpe.END})


def test_letters_with_and_without_marks(spark, library):
    words = ["Café", "ª", "µ,", "º.", "×", "÷;", "naïve!", "a,,", ",", "..", "Ǆ:", "ʼn?", "ɐ.", "ɏ", "x1,", "it's", "ß", "don't.", "a.b", "é,"]
    texts = [" ".join(words), *("x " + w + " y" for w in words), *("x " + w for w in words), *words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, P.PATTERN).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_of_a_low_count_all_words_are_taken_that_fit(spark):
    counts = spark.createDataFrame([(bytes([a, b]), a) for a in (2, 3, 70, 130) for b in range(10)], "word binary, n long")
    assert [sorted({r.n for r in byte_bpe.frequent(counts, most).collect()}) for most in (9, 15, 35, 40)] == [[], [130], [3, 70, 130], [2, 3, 70, 130]]


def test_words_are_counted_as_the_pattern_matches_them(spark):
    texts = ["One two.\nOne 12 two,", "One  two", "", None, "x" * 49, "éa é 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = Counter(w.encode() for t in texts if t for w in regex.findall(P.PATTERN, t) if len(w.encode()) <= 48)
    assert {bytes(r.word): r.n for r in byte_bpe.word_counts(docs, P.PATTERN, 48).collect()} == want


def test_recurring_words_of_any_kind_are_not_folded_in_blocks(spark):
    docs = spark.createDataFrame([(i, "Word\nWord, 12 it's  two.\nEnd") for i in range(40)], "doc_id long, text string").coalesce(1)
    blocks = byte_bpe.folded_blocks(docs, PATH, P.PATTERN, 1000, 48, 100, 1024, "doc_id").collect()
    assert len(blocks) > 2 and not any(b.found for b in blocks)


def test_digests_leave_the_worker_that_fills_the_holes(spark):
    plan = byte_bpe.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


@pytest.mark.parametrize("most", [0, 1000])
def test_digests_of_odd_texts_in_small_batches(spark, most):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(1, 60))) for _ in range(400)] + [None, "", " ", "  ", "a ", " a", "ab" * 700 + " b", "b " * 3000]
    docs = spark.createDataFrame([(None if i == 9 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    settings = {"most": most, "block_chars": 300}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = byte_bpe.encode_digests(docs, PATH, P.PATTERN, **settings).collect()
        want = byte_bpe.decode_digests(byte_bpe.encode(docs, PATH, P.PATTERN, **settings), PATH).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(texts)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)


def test_plans_do_not_spell_the_rank_table_out(spark):
    plan = byte_bpe.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert len(plan) < 200_000


def test_latin_stretches_are_matched_without_the_pattern(library):
    texts = pa.array(["x Café naïve! it's a, ɐ. , ß\nEnd. no\n\nno", "y Café ÷ ab12 a,\nb", None, "", "z  joint", "Café"])
    asked = []
    cut = byte_bpe.Stretches(texts, lambda s: asked.append(s) or regex.findall(P.PATTERN, s))
    assert asked == [" it's", " ɐ.", " ,", " no\n\nno", " ÷", " ab12"]
    assert cut.distinct.take(pa.array(cut.plain)).to_pylist() == ["Café", "naïve!", "a,"] and [chr(m) for m in cut.marked] == ["\0", "!", ","]
    odd = cut.distinct.take(pa.array(cut.odd)).to_pylist()
    want = [w for s in odd for w in regex.findall(P.PATTERN, " " + s)]
    assert odd == ["it's", "ɐ.", ",", "ß\nEnd.", "no\n\nno", "÷", "ab12", "a,\nb"] and cut.parts.sum() == len(want)
    assert [w.decode() for w in cut.words.to_pylist()] == [" Café", " naïve", " a", *want] and cut.alone == ["x", "y", "", "", "z  joint", "Café"]


def test_words_are_looked_up_together_as_one_by_one():
    draw = random.Random(4)
    words = list({bytes(draw.choices(b"abc\xff", k=draw.randint(1, 48))) for _ in range(3000)} | {b" " * n for n in range(1, 49)})
    there, mask = sorted(words[::2], key=lambda w: zlib.crc32(w) & 255), 255
    entries = [len(w).to_bytes(2, "little") + (4 * (len(w) % 3 + 1)).to_bytes(2, "little") + w + w[:1] * (4 * (len(w) % 3 + 1)) for w in there]
    sizes = np.bincount([zlib.crc32(w) & mask for w in there], [len(e) for e in entries], mask + 1)
    known = byte_bpe.Words(np.append(0, np.cumsum(sizes)).astype("<u4").tobytes(), b"".join(entries) + bytes(8))
    asked = [*words, b"", b"a" * 500, b"a" * 48 + b"b"]
    counts, ids = known.get_each(pa.array([b"left out", *asked], pa.binary())[1:], 48)
    want = [known.get(w) or b"" for w in asked]
    assert sum(map(bool, want)) == len(there) and counts.tolist() == [len(w) // 4 for w in want] and ids.astype("<u4").tobytes() == b"".join(want)
    none = byte_bpe.Words(np.zeros(2, "<u4").tobytes(), bytes(8))
    assert not none.get_each(pa.array(asked, pa.binary()), 48)[0].any() and not len(known.get_each(pa.array([], pa.binary()), 48)[0])


def test_pieces_of_many_texts_are_joined_by_one_look():
    pieces = pa.array([b"a", b"", b"\xff\xfe", None], pa.large_binary())
    ids = pa.array([[9], [0, 2, 1], [], [2], [0] * 5], pa.list_(pa.int32()))[1:]
    assert [bytes(d) for d in byte_bpe.joined_each(ids, pieces)] == [b"a\xff\xfe", b"", b"\xff\xfe", b"aaaaa"]
    assert [bytes(d) for d in byte_bpe.joined_each(ids[1:2], pieces)] == [b""] and byte_bpe.joined_each(ids[:0], pieces) == []
    for wrong in ([4], [-1], [3], [0, None]):
        with pytest.raises(ValueError, match="vocabulary"):
            byte_bpe.joined_each(pa.array([[0], wrong], pa.list_(pa.int32())), pieces)
