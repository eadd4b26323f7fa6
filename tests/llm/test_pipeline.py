"""The pipeline, stage by stage, against brute force."""

import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_join import brute as brute_components
from tests.llm.test_native import PATTERNS
from tests.llm.test_repeats import WORD
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_tokens import pieces_hold
from trailmix.llm import secrets
from trailmix.llm.common import stored

SF = "/root/testdata/sf0.001"


def brute_redacted(text):
    spans = []
    for rx, group, least in PATTERNS.values():
        spans += [m.span() for m in rx.finditer(text) if len(m[group]) >= least]
    for rule in secrets.RULES[len(secrets.BASE) :]:
        spans += [m.span() for m in re.finditer(rule.pattern, text)]
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        out.append(stored(stage(spark, out[-1], SF), name))
        assert out[-1].columns == docs.columns
    return out


def held(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxic_documents_go(spark, steps):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = held(steps[0]), held(steps[1])
    assert all(before[i] == t for i, t in after.items())
    clean = [i for i in before if marks.get(i) == 0]
    assert sum(i in after for i in clean) > 0.95 * len(clean)


def test_one_of_each_group_stays(steps):
    before, after = held(steps[1]), held(steps[2])
    groups = brute_components(list(before.items()), 80, 5)
    assert {str(i) for i in after} == {d for d, _, c in groups if d == c}


def test_similar_on_five_words_go(spark, steps):
    def copy(kind, edits):
        return " ".join(f"edit{k}" if k in edits else f"{kind}{k}" for k in range(100))

    rows = [(1, copy("a", ())), (2, copy("a", (30, 60))), (3, copy("b", ())), (4, copy("b", (20, 50, 80)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], steps[0].schema)
    assert set(held(pipeline.keep_one_of_similar(spark, docs, SF))) == {1, 3, 4}  # similarities 0.81 and 0.73


def test_repeats_go(steps):
    before, after = held(steps[2]), held(steps[3])
    want = {int(d): (n, gone, kept) for d, n, gone, kept in brute_repeats(list(before.items()))}
    assert set(after) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    assert all(" ".join(WORD.findall(t)) == want[i][2] for i, t in after.items())
    assert all(t == before[i] for i, t in after.items() if not want[i][1])


def test_secrets_are_marked(steps):
    before, after = held(steps[3]), held(steps[4])
    assert after == {i: brute_redacted(t) for i, t in before.items()}
    assert steps[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_the_rest_is_packed(spark, steps):
    rows = pipeline.STAGES[-1][1](spark, steps[4], SF).collect()
    pieces_hold(rows, held(steps[4]), Tokenizer.from_file(P.path("byte_bpe_50k.json")), 1024)


def test_run_gives_the_last_stage(spark, steps):
    assert {(r.doc_id, r.start, r.length) for r in pipeline.run(spark, SF).collect()} == {(r.doc_id, r.start, r.length) for r in pipeline.STAGES[-1][1](spark, steps[4], SF).collect()}
