"""Token counts: byte-pair merging by a heap over a linked list, counting without naming the tokens."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmix.llm.common import STABLE_CHARACTERS, ByteBPE, read_small, table

NAME = "op4_token_counts"
CACHE_ENTRIES = 400_000


def merged_length(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols are left when the adjacent pair of lowest rank, leftmost first, is merged until none is ranked.

    The heap holds (rank, position); ``prev``/``next`` link the live symbols. An entry is stale once either
    of its symbols has changed. The answer is the number of initial symbols minus the number of merges.
    """
    n = len(symbols)
    if n < 2:
        return n
    ids = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    after[-1] = -1
    heap = []
    for i in range(n - 1):
        found = merges.get((ids[i], ids[i + 1]))
        if found:
            heap.append((found[0], i, found[1]))
    heapq.heapify(heap)
    count = 0
    while heap:
        rank, i, made = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or merges.get((ids[i], ids[j])) != (rank, made):
            continue
        count += 1
        ids[i], ids[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            found = merges.get((made, ids[k]))
            if found:
                heapq.heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get((ids[h], made))
            if found:
                heapq.heappush(heap, (found[0], h, found[1]))
    return n - count


class _Counts(dict):
    """Tokens of `` `` + chunk by chunk, computed when first asked for; emptied when full."""

    def __init__(self, split: Callable[[str], list[str]], bpe: ByteBPE):
        super().__init__()
        self.split, self.bpe, self.words = split, bpe, {}

    def of(self, text: str) -> int:
        total, words, byte_ids, merges = 0, self.words, self.bpe.byte_ids, self.bpe.merges
        for word in self.split(text):
            n = words.get(word)
            if n is None:
                n = merged_length([byte_ids[b] for b in word.encode("utf-8", "replace")], merges)
                if len(word) < 64:
                    if len(words) >= CACHE_ENTRIES:
                        words.clear()
                    words[word] = n
            total += n
        return total

    def __missing__(self, chunk: str) -> int:
        n = self.of(" " + chunk)
        if len(chunk) < 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


class TokenCounter:
    """Counts as the ``tokenizers`` library gives them, without special tokens added; those inside a text count as one."""

    def __init__(self, spec: str, pattern: str):
        self.bpe = ByteBPE(spec)
        find = regex.compile(pattern).findall
        self.library = Tokenizer.from_str(spec).pre_tokenizer
        self.fast = _Counts(find, self.bpe)
        self.exact = lambda text: [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _plain(self, text: str) -> int:
        if not text.isascii() and STABLE_CHARACTERS.search(text):
            total, counts = 0, self.fast
            counts.split, held = self.exact, counts.split
            try:
                total = counts.of(text)
            finally:
                counts.split = held
            return total
        # A space after a character that is no white space always begins a new piece, so chunks between such spaces are independent.
        if "  " in text or any(f"{c} " in text for c in ("\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f" if text.isascii() else _WHITE)):
            return self.fast.of(text)
        first, *rest = text.split(" ")
        if not first:
            return self.fast.of(text)
        return self.fast.of(first) + sum(map(self.fast.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        added = self.bpe.split_added
        if added is not None and any(a in text for a in self.bpe.added):
            return sum(1 if part in self.bpe.added else self._plain(part) for part in added.split(text) if part)
        return self._plain(text)


#: White space characters of Unicode besides the blank, as ``str.isspace`` has them.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")

_counters: dict[tuple[str, str], TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit in place of ``text``.

    A pure map over the scan: no shuffle, and each task holds one batch and a bounded cache of words.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each for itself; a very long
    text or word costs n log n. Other columns pass through unless they bear the name of a result.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c != text and c not in made]
    spec = docs.sparkSession.sparkContext.broadcast(read_small(vocabulary))
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, pattern)
        counter = _counters.get(key)
        if counter is None:
            _counters.clear()
            counter = _counters[key] = TokenCounter(spec.value, pattern)
        for batch in batches:
            texts = batch.column(len(keep))
            counts = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            over = pc.greater(counts, limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes, counts, over], names=[*keep, *made])

    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
