"""Fingerprints against a MinHash written in plain Python, with bins, densification, low bits and bias one by one."""

import struct

import pytest
import xxhash

from trailmix.llm import fingerprints

BINS, SHIFT = 128, 56


def hashed(*values) -> int:
    """Spark's xxhash64 of several values: each is hashed with the hash before as its seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Small) else "<q", v)
        seed = xxhash.xxh64(data, seed).intdigest()
    return seed


class Small(int):
    """A whole number of 32 bits."""


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketch(text: str) -> list[int]:
    words = text.split()
    if not words:
        return []
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] or [words]
    least: dict[int, int] = {}
    for s in shingles:
        x = hashed(*s) >> 1
        least[x >> SHIFT] = min(x, least.get(x >> SHIFT, x))
    out = []
    for b in range(BINS):
        if b not in least:  # the filled bin that a hash of both numbers ranks first gives its value
            donor = min(least, key=lambda f: (signed(hashed(Small(b), f)), least[f]))
            out.append(least[donor] & 255)
        else:
            out.append(least[b] & 255)
    return out


def alike(a: list[int], b: list[int]) -> float:
    if not a or not b:
        return float(len(a) == len(b))
    same = sum(x == y for x, y in zip(a, b, strict=True)) / BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_sketches_equal_the_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    docs = [(i, t) for i, t in docs if t.isascii() or not any(c.isspace() and c not in " \t\n\x0b\x0c\r" for c in t)][:25]
    docs += [(10**6 + k, t) for k, t in enumerate(["", "one", "a b c d", "w " * 400, "é 𝔘 ñ z q r", "same words here and there " * 3])]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        own, changed, following = sketch(t), sketch(t[: len(t) - half] + after[:half]), sketch(after)
        r = got[i]
        assert r.fingerprint == "".join(f"{v:02x}" for v in own) and r.edited_fingerprint == "".join(f"{v:02x}" for v in changed), i
        assert (r.near_edited, r.near_next) == (pytest.approx(alike(own, changed)), pytest.approx(alike(own, following)))


def test_ids_crowded_in_a_small_part_of_the_range(spark):
    docs = [(i, f"text {i} " * 8) for i in range(700)] + [(2**62, "far away"), (-(2**62), "far below")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    order = sorted(texts)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert got[a].near_next == pytest.approx(alike(sketch(texts[a]), sketch(texts[b])))
