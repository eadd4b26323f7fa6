"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words; decoding joins binary pieces."""

from __future__ import annotations

import base64
import hashlib
import heapq
import inspect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmix.llm.common import lean, read_small, stored, table

NAME = "op2_byte_bpe"
ID_BITS = 20
LOW = (1 << ID_BITS) - 1
NONE = 1 << ID_BITS  # rank of a pair that has none
END = LOW  # symbol before and after a word; it pairs with nothing
EMPTY = 1 << 3 * ID_BITS  # slot of the rank table that no pair has


def read_ranks(text: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the rank of their joined bytes, which is also the id of the merged token."""
    return {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}


def rank_map(pairs: dict[tuple[int, int], int]) -> tuple[list[int], tuple[int, int]]:
    """The pair ranks as a table in which each pair has one of two slots, its key modulo either divisor: entries are key | rank.

    A pair whose slots are taken moves the one that it meets to that one's other slot. A larger vocabulary than of
    2**20 - 1 ids is refused, as END needs one.
    """
    if any(max(*p, r) >= END for p, r in pairs.items()):
        raise ValueError("the vocabulary has ids beyond 2**20 - 2")
    size = max(1024, 5 * len(pairs) // 2)
    while True:
        one = _prime_below(size)
        two = _prime_below(one - 1)
        table = [EMPTY] * one
        if all(_placed(table, one, two, key_of(a, b) | r) for (a, b), r in pairs.items()):
            return table, (one, two)
        size *= 2


def key_of(left, right):
    return (left << 2 * ID_BITS) | (right << ID_BITS)


def _prime_below(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n -= 1
    return n


def _placed(table: list[int], one: int, two: int, entry: int) -> bool:
    at = -1
    for _ in range(500):
        key = entry & ~LOW
        at = key % two if at == key % one else key % one
        entry, table[at] = table[at], entry
        if entry == EMPTY:
            return True
    return False


def first_ranks(ranks: dict[bytes, int], byte_ids: np.ndarray) -> np.ndarray:
    """For two neighbours in a word, END counted as byte 256: the rank of their pair and the left one's id, as a state of the fold has them."""
    found = np.full((257, 257), NONE, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            found[token[0], token[1]] = rank
    return (found << 2 * ID_BITS) + np.append(byte_ids, END)[:, None]


def spelled(words: list[bytes], firsts: np.ndarray) -> pa.ListArray:
    """Each word as the fold's first state: its bytes with END before them and twice after them, n + 2 numbers of n bytes; see ``folded``."""
    ends = np.cumsum([0, *(len(w) + 2 for w in words)])
    symbols = np.append(np.frombuffer(b"".join([b"\0%b\0" % w for w in words]), np.uint8).astype(np.int64), 256)
    symbols[ends] = 256
    symbols[ends[1:] - 1] = 256
    places = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(firsts[symbols[:-1], symbols[1:]] + (places << ID_BITS)))


def folded(begin: Column, ranks: Column, divisors: tuple[int, int]) -> Column:
    """The ids of a spelled word: n - 1 times, the leftmost pair of lowest rank is merged, if any has a rank.

    The state has for each symbol the rank of its pair with the next one, its place in the word and the symbol, in one
    number, whose minimum so is that pair; ``begin`` is that of the bytes, and a merge looks up two pairs anew. A key differs from any other's entry above
    the bits of the rank, so that the exclusive or is the rank where the pair has one and NONE or more elsewhere.
    """
    whole = lambda n: F.lit(n).cast("bigint")
    rest = (1 << 2 * ID_BITS) - 1

    def rank(key: Column) -> Column:
        """A pair's rank in its bits of the state."""
        return F.shiftleft(F.least(*[F.get(ranks, key % whole(d)).bitwiseXOR(key) for d in divisors], whole(NONE)), 2 * ID_BITS)

    def bound(value: Column, use) -> Column:
        """``use(value)`` with ``value`` computed once."""
        return F.get(F.transform(F.array(value), use), 0)

    def merged(state: Column, low: Column, at: Column) -> Column:
        made = F.shiftright(low, 2 * ID_BITS)
        before, after = F.get(state, at - 2), F.get(state, at + 1)
        firsts = F.array(before.bitwiseAND(whole(rest)), low.bitwiseAND(whole(rest - LOW)) + made)
        new = F.zip_with(
            firsts,
            F.array(F.shiftleft(before.bitwiseAND(whole(LOW)), 2 * ID_BITS) + F.shiftleft(made, ID_BITS), F.shiftleft(made, 2 * ID_BITS) + F.shiftleft(after.bitwiseAND(whole(LOW)), ID_BITS)),
            lambda first, key: rank(key) + first,
        )
        return F.flatten(F.array(F.slice(state, F.lit(1), at - 2), new, F.slice(state, at + 2, F.size(state))))

    def step(state: Column, _: Column) -> Column:
        return bound(
            F.array_min(state),
            lambda low: F.when(low >= whole(NONE << 2 * ID_BITS), state).otherwise(bound(F.array_position(state, low).cast("int"), lambda at: merged(state, low, at))),
        )

    symbols = lambda state: F.transform(F.slice(state, F.lit(2), F.size(state) - 2), lambda x: x.bitwiseAND(whole(LOW)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.size(begin) - 3), begin, step, symbols)


def heap_merged(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges by a heap over linked symbols, for words so long that a quadratic fold would not end."""
    ids, n = list(ids), len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        low, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or pairs.get((ids[i], ids[j])) != low:
            continue
        ids[i], ids[j] = low, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (low, ids[k]) in pairs:
                heapq.heappush(heap, (pairs[low, ids[k]], i))
        h = before[i]
        if h >= 0 and (ids[h], low) in pairs:
            heapq.heappush(heap, (pairs[ids[h], low], h))
    return [x for x in ids if x >= 0]


#: Texts are kept apart at blanks only for patterns whose matches never reach past a blank that something other than white space follows.
APART = (public_tokenizers.PATTERN,)


def _bytes_of(those: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(those.encode(), np.uint8))


LETTERS = _bytes_of("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
MARKS = _bytes_of(",.;:!?")
#: Of two bytes as one number, lower one last: whether they are a Latin letter.
LATIN = np.zeros(1 << 16, bool)
LATIN[[int.from_bytes(c.encode(), "big") for c in map(chr, range(0x80, 0x250)) if c.isalpha()]] = True
WHITE = _bytes_of("".join(c for c in map(chr, range(128)) if c.isspace()))


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, with eight more after the last, and the bounds of each."""
    whole = strings.cast(pa.large_binary())
    if not len(whole):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return np.append(data, np.zeros(8, np.uint8)), bounds - bounds[0]


def spans(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each of ``firsts`` on, as many as ``counts`` has, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Stretches:
    """A batch of texts, cut at blanks by Arrow: ``distinct`` has each stretch between blanks once, ``places`` the one at each position.

    ``starts`` has each text's first position; what stands there has no blank before it. Texts with a blank within a
    run of white space, which is matched as a whole, are ``joint``; ``counts`` leaves those and all first stretches out.
    ``words`` are the matches in stretches that are counted, with the blank before them: one in each of ``plain``, Latin letters, whose mark after
    them is in ``marked`` if it is not 0, and then, as many as ``parts`` has, in each of ``odd``, found by the pattern.
    """

    def __init__(self, texts: pa.Array, find):
        parts = pc.split_pattern(texts.fill_null(""), " ")
        found = parts.flatten().dictionary_encode()
        self.starts = parts.offsets.to_numpy()[:-1] if len(texts) else np.zeros(0, np.int32)
        self.places, self.distinct = found.indices.to_numpy(), found.dictionary
        self.sizes = parts.value_lengths().to_numpy()
        self.later = np.ones(len(self.places), bool)
        self.later[self.starts] = False
        data, bounds = flat(self.distinct)
        first, size = bounds[:-1], np.diff(bounds)
        letter, latin = LETTERS[data], LATIN[data[:-1].astype(np.uint16) << 8 | data[1:]]
        letter[:-1] |= latin
        letter[1:] |= latin
        white = (size == 0) | WHITE[data[first]]
        beyond = np.flatnonzero((size > 0) & (data[first] >= 128) & ~letter[first])
        white[beyond] = [s[0].isspace() for s in self.distinct.take(pa.array(beyond)).to_pylist()]
        self.joint = np.logical_or.reduceat(white[self.places] & self.later, self.starts) if len(texts) else np.zeros(0, bool)
        self.later &= ~np.repeat(self.joint, self.sizes)
        self.counts = np.bincount(self.places[self.later], minlength=len(self.distinct))
        heads = self.distinct.take(pa.array(self.places[self.starts])).to_pylist()
        self.alone = [t if j else s for t, j, s in zip(texts.to_pylist() if self.joint.any() else heads, self.joint, heads)]
        last = data[bounds[1:] - 1]
        marked = MARKS[last] & (size > 1)
        others = np.append(0, np.cumsum(~letter))
        plain = (size > 0) & (others[bounds[1:]] - others[first] == marked)
        self.plain, self.odd = np.flatnonzero(plain & (self.counts > 0)), np.flatnonzero(~plain & (self.counts > 0))
        self.marked = np.where(marked, last, 0)[self.plain]
        letters = pc.ascii_rtrim(self.distinct.take(pa.array(self.plain)), ",.;:!?")
        matches = [self.matches(x, find) for x in self.distinct.take(pa.array(self.odd)).to_pylist()]
        self.parts = np.array([len(m) for m in matches], np.int64)
        self.words = pa.concat_arrays([pc.binary_join_element_wise("", letters, " ").cast(pa.binary()), pa.array([w.encode() for m in matches for w in m], pa.binary())])

    @staticmethod
    def plainly(s: str) -> list[str] | None:
        """``s`` apart at its last character if that is a mark; None unless all others are Latin letters."""
        end = -1 if s[-1] in ",.;:!?" else len(s)
        if s[:end].isalpha() and (s.isascii() or max(s) < "\u0250"):
            return [s] if end > 0 else [s[:end], s[end:]]
        return None

    @staticmethod
    def matches(s: str, find) -> list[str]:
        """The matches in a blank and the stretch after it; the pattern is spared for Latin letters, also before one mark, at either side of a line's end."""
        head, _, tail = s.partition("\n")
        if head and tail and (one := Stretches.plainly(head)) and (two := Stretches.plainly(tail)):
            return [" " + one[0], *one[1:], "\n", *two]
        return find(" " + s)


def word_counts(docs: DataFrame, pattern: str, longest: int) -> DataFrame:
    """(word, n) of the pattern's matches of up to ``longest`` bytes in all texts, which tells those worth folding beforehand. Tasks sum before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = regex.compile(pattern).findall, Counter()
        found: list[tuple[pa.Array, np.ndarray]] = []

        def rows(words: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([words, pa.array(numbers, pa.int64())], names=["word", "n"])

        def out() -> pa.RecordBatch:
            made = [(raw, n) for raw, n in ((w.encode(), n) for w, n in counts.items()) if len(raw) <= longest]
            counts.clear()
            return rows(pa.array([w for w, _ in made], pa.binary()), np.array([n for _, n in made], np.int64))

        def summed() -> pa.RecordBatch:
            words, numbers = pa.concat_arrays([w for w, _ in found]).dictionary_encode(), np.concatenate([n for _, n in found])
            found.clear()
            return rows(words.dictionary, np.bincount(words.indices.to_numpy(), numbers, len(words.dictionary)).astype(np.int64))

        def whole(texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            for text in texts:
                if text:
                    counts.update(w for w in find(text) if len(w) <= longest)
                    if len(counts) > 300_000:
                        yield out()

        for batch in batches:
            if pattern not in APART:
                yield from whole(batch.column(0).to_pylist())
                continue
            cut = Stretches(batch.column(0), find)
            numbers = np.append(cut.counts[cut.plain], np.repeat(cut.counts[cut.odd], cut.parts))
            fits = pc.less_equal(pc.binary_length(cut.words), longest)
            found.append((cut.words.filter(fits), numbers[fits.to_numpy(zero_copy_only=False)]))
            marks = np.bincount(cut.marked, cut.counts[cut.plain], 256).astype(np.int64)
            counts.update({chr(m): int(marks[m]) for m in np.flatnonzero(marks[1:]) + 1})
            if sum(len(w) for w, _ in found) > 600_000:
                yield summed()
            yield from whole(cut.alone)
            if len(counts) > 300_000:
                yield out()
        if found:
            yield summed()
        yield out()

    return docs.select("text").mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words that occur twice or more, of the lowest count class down to which at most ``most`` words exist, and all above.

    A class is a single count below 64, a power of two from there on: the driver gets some 120 of them at most.
    """
    kind = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n")) + 58)
    classes = {r["kind"]: r["count"] for r in counts.where("n > 1").groupBy(kind.alias("kind")).count().collect()}
    total, least = 0, 1 << 20
    for c in sorted(classes, reverse=True):
        total += classes[c]
        if total > most:
            break
        least = c
    return counts.where((F.col("n") > 1) & (kind >= least))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = table >> 1 ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


CRC_TABLE = _crc_table()


def crc32s(data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each stretch of ``data``, byte after byte of all of them."""
    order = np.argsort(-sizes, kind="stable")
    at, falling, state = firsts[order], -sizes[order], np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for k in range(-falling[0] if len(falling) else 0):
        some = state[: np.searchsorted(falling, -k)]  # those of more than k bytes
        some[:] = CRC_TABLE[(some ^ data[at[: len(some)] + k]) & 255] ^ some >> 8
    found = np.empty_like(state)
    found[order] = ~state
    return found


def numbers_at(data, kind: str) -> np.ndarray:
    """The numbers of ``kind`` that begin at each byte of ``data``, as a view."""
    return np.ndarray(max(0, len(data) - np.dtype(kind).itemsize + 1), kind, data, strides=(1,))


class Words:
    """Words and their ids in one string of bytes, ordered by bucket: lengths in two bytes each, the word, its ids. Buckets are by CRC-32."""

    def __init__(self, starts: bytes, entries: bytes):
        self.starts, self.entries = memoryview(starts).cast("I"), entries
        self.mask = len(self.starts) - 2

    def get(self, word: bytes) -> bytes | None:
        bucket = zlib.crc32(word) & self.mask
        at, end, entries = self.starts[bucket], self.starts[bucket + 1], self.entries
        while at < end:
            middle = at + 4 + (entries[at] | entries[at + 1] << 8)
            after = middle + (entries[at + 2] | entries[at + 3] << 8)
            if entries[at + 4 : middle] == word:
                return entries[middle:after]
            at = after
        return None

    def get_each(self, words: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of ``words`` has, 0 where it is not there, and all these ids. No entry's word is over ``longest`` bytes, and eight bytes follow the last entry."""
        data, bounds = flat(words)
        firsts, sizes = bounds[:-1], np.diff(bounds)
        short, own, theirs = numbers_at(self.entries, "<u2"), numbers_at(data, "<u8"), numbers_at(self.entries, "<u8")
        starts, buckets = np.asarray(self.starts), crc32s(data, firsts, np.minimum(sizes, longest)) & np.uint32(self.mask)
        at, ends = starts[buckets].astype(np.int64), starts[buckets + 1].astype(np.int64)
        begin, counts, left = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.flatnonzero(at < ends)
        while len(left):
            here = at[left]
            length, n = short[here].astype(np.int64), short[here + 2].astype(np.int64)
            same = np.flatnonzero(length == sizes[left])
            for k in range(0, int(length[same].max(initial=0)), 8):
                rest = length[same] - k
                spare = np.clip(8 - rest, 0, 7).astype(np.uint64) * np.uint64(8)
                most = np.where(rest > 0, k, 0)  # a word that has ended is compared from its start again
                unlike = own[firsts[left[same]] + most] ^ theirs[here[same] + 4 + most]
                same = same[(rest <= 0) | (unlike << spare == 0)]
            begin[left[same]], counts[left[same]] = (here + 4 + length)[same], n[same] >> 2
            at[left] = here + 4 + length + n
            at[left[same]] = ends[left[same]]
            left = left[at[left] < ends[left]]
        return counts, numbers_at(self.entries, "<u4")[np.repeat(begin, counts) + 4 * spans(np.zeros(len(counts), np.int64), counts)]

    @staticmethod
    def packed(words: DataFrame, fold, buckets: int) -> tuple[bytes, bytes]:
        """The two parts, of ``words`` with ids by ``fold``; tasks hold ranges of buckets, so that the driver only joins strings."""

        firsts = fold.firsts

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spelled(found, firsts)], names=["word", "bucket", "state"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = []
            for batch in batches:
                flat, at = batch.column(2).flatten().to_numpy().astype("<u4").tobytes(), 0
                for word, bucket, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).value_lengths().to_pylist(), strict=True):
                    data, at = flat[at : at + 4 * n], at + 4 * n
                    rows.append((bucket, len(word).to_bytes(2, "little") + len(data).to_bytes(2, "little") + word + data))
            rows.sort()
            parts = np.array([b for b, _ in rows], "<u4").tobytes(), np.array([len(e) for _, e in rows], "<u4").tobytes(), b"".join([e for _, e in rows])
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] if rows else [0], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], names=["first", "buckets", "sizes", "entries"])

        parts = words.sparkSession.sparkContext.defaultParallelism
        placed = words.select("word", F.crc32("word").bitwiseAND(F.lit(buckets - 1).cast("bigint")).alias("bucket")).repartitionByRange(parts, "bucket")
        spelt = placed.mapInArrow(lean(spell), "word binary, bucket long, state array<bigint>")
        made = fold.ids(spelt, "state", "ids").mapInArrow(lean(pack), "first long, buckets binary, sizes binary, entries binary")
        rows = sorted(made.where(F.length("buckets") > 0).collect(), key=lambda r: r["first"])
        found = np.frombuffer(b"".join([r["buckets"] for r in rows]), "<u4")
        sizes = np.frombuffer(b"".join([r["sizes"] for r in rows]), "<u4")
        starts = np.concatenate([[0], np.cumsum(np.bincount(found, sizes, buckets))]).astype("<u4")
        return starts.tobytes(), b"".join([*(r["entries"] for r in rows), bytes(8)])


class Fold:
    """The fold of a vocabulary: its bytes' ids and the literal rank table.

    The table is a local relation of one row that a scalar subquery hands to the plan: an array literal would stand in every text of a plan, of which Spark's
    driver keeps some for each query, with all of its 270,000 numbers.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        slots, self.divisors = rank_map(pair_ranks(ranks))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.firsts = first_ranks(ranks, self.byte_ids)
        self.table = spark.createDataFrame(pa.table({"slots": pa.array([slots], pa.list_(pa.int64()))})).scalar()

    def ids(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the ids of a spelled word in ``column`` as ``name``, in place of it."""
        return self._folded(rows, column, name, lambda m: folded(F.col(column), m, self.divisors))

    def ids_each(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """The same for an array of spelled words."""
        return self._folded(rows, column, name, lambda m: F.transform(column, lambda w: folded(w, m, self.divisors)))

    def _folded(self, rows: DataFrame, column: str, name: str, use) -> DataFrame:
        """Subqueries must not stand within higher-order functions, so the table has a column of its own, which Spark collapses with the next."""
        others = [c for c in rows.columns if c != column]
        return rows.select("*", self.table.alias("_ranks")).select(*others, F.get(F.transform(F.array("_ranks"), use), 0).alias(name))


_pairs: dict[str, dict] = {}


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, most: int = 1_200_000, longest: int = 48, block_chars: int = 2_000_000, fold_bytes: int = 1024, key: str = "doc_id",
) -> DataFrame:
    """One row per document: key, ids (array of int).

    Words are folded once for the corpus if they are among the ``most`` frequent ones of up to ``longest`` bytes
    (that map is broadcast; its size is bounded by the two), else once for each block of ``block_chars`` characters.
    Words of one occurrence, most of the distinct ones, are so folded once in any case.
    Blocks stay in the task that reads them, so texts are not shuffled. Words over ``fold_bytes`` bytes, for which
    the fold's quadratic cost would tell, are merged by a heap to the same ids. Null and empty texts have no ids;
    a null key stays null; repeated rows are encoded each; extra columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    return folded_blocks(docs, vocabulary, pattern, most, longest, block_chars, fold_bytes, key).mapInArrow(lean(filled), f"doc_id {kind}, ids array<int>")


def folded_blocks(docs: DataFrame, vocabulary: str, pattern: str, most: int, longest: int, block_chars: int, fold_bytes: int, key: str) -> DataFrame:
    """Blocks of (keys, streams of ids with holes, ids of the words that fill them), of ``encode``'s arguments; see ``filled``."""
    spark = docs.sparkSession
    text = read_small(vocabulary)
    fold = Fold(spark, read_ranks(text))
    byte_ids, firsts = fold.byte_ids, fold.firsts
    chosen = docs.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stored(word_counts(chosen, pattern, longest), "bpe-words")
    shared = spark.sparkContext.broadcast(Words.packed(frequent(counts, most), fold, 1 << most.bit_length() - 1 if most else 1))
    spec = spark.sparkContext.broadcast(text)
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of (keys, streams of ids with holes, spelled words missing from the map). A hole is 2**31 + its place among the missing."""
        find, shared_words = regex.compile(pattern).findall, Words(*shared.value)
        known = shared_words.get
        #: Ids of what was seen: words all of them known, and words with holes of this block.
        words, open_words = {}, {}
        keys, streams, missing, chars = [], [], {}, 0
        key_kind = None

        def hole(raw: bytes) -> bytes:
            if len(raw) > fold_bytes:
                if vocabulary not in _pairs:
                    _pairs[vocabulary] = pair_ranks(read_ranks(spec.value))
                return np.array(heap_merged(byte_ids[np.frombuffer(raw, np.uint8)].tolist(), _pairs[vocabulary]), "<u4").tobytes()
            return ((1 << 31) + missing.setdefault(raw, len(missing))).to_bytes(4, "little")

        def kept(seen: dict, name: str, ids: bytes) -> None:
            if len(name) <= longest:
                if len(seen) >= 100_000:
                    seen.clear()
                seen[name] = ids

        def of_word(word: str) -> bytes:
            raw = word.encode()
            ids = known(raw) if len(raw) <= longest else None
            if ids is not None:
                kept(words, word, ids)
                return ids
            ids = hole(raw)
            kept(open_words, word, ids)
            return ids

        def by_words(value: str | None) -> bytes:
            return b"".join([words.get(w) or open_words.get(w) or of_word(w) for w in find(value)]) if value else b""

        def by_stretches(texts: pa.Array) -> list[bytes]:
            cut = Stretches(texts, find)
            counts, ids = shared_words.get_each(cut.words, longest)
            lacking, mark = np.flatnonzero(counts == 0), np.flatnonzero(cut.marked)
            open_ids = [hole(w) for w in cut.words.take(pa.array(lacking)).to_pylist()]
            alone = [by_words(t) for t in cut.alone]
            #: The ids of each word, and the mark's after them, then those of each text's first stretch or of the whole text.
            sizes = np.concatenate([counts, [len(x) // 4 for x in alone]]).astype(np.int64)
            sizes[lacking] = [len(x) // 4 for x in open_ids]
            sizes[mark] += 1
            firsts = np.cumsum(sizes) - sizes
            pool = np.empty(sizes.sum(), np.uint32)
            pool[spans(firsts[: len(counts)], counts)] = ids
            pool[spans(firsts[lacking], sizes[lacking] - np.isin(lacking, mark))] = np.frombuffer(b"".join(open_ids), "<u4")
            pool[firsts[mark] + sizes[mark] - 1] = byte_ids[cut.marked[mark]]
            pool[len(pool) - sizes[len(counts) :].sum() :] = np.frombuffer(b"".join(alone), "<u4")
            n_plain, n = len(cut.plain), len(cut.distinct)
            begin, length = np.zeros(n + len(alone), np.int64), np.zeros(n + len(alone), np.int64)
            begin[cut.plain], length[cut.plain] = firsts[:n_plain], sizes[:n_plain]
            if len(cut.odd):
                parts = n_plain + np.cumsum(cut.parts) - cut.parts
                begin[cut.odd], length[cut.odd] = firsts[parts], np.add.reduceat(sizes[: len(counts)], parts)
            begin[n:], length[n:] = firsts[len(counts) :], sizes[len(counts) :]
            places = np.where(cut.later, cut.places, 0)
            places[cut.starts] = n + np.arange(len(alone))
            used = cut.later.copy()
            used[cut.starts] = True
            counts = np.where(used, length[places], 0)
            data = pool[spans(begin[places], counts)].astype("<u4", copy=False).tobytes()
            bounds = [0, *(4 * np.cumsum(counts)[cut.starts + cut.sizes - 1]).tolist()]
            return [data[a:b] for a, b in zip(bounds, bounds[1:])]

        def out() -> pa.RecordBatch:
            lacking = spelled(list(missing), firsts)
            made = pa.RecordBatch.from_arrays(
                [pa.array([keys], pa.list_(key_kind)), pa.array([streams], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(lacking)], pa.int32()), lacking)],
                names=["keys", "streams", "missing"],
            )
            keys.clear(), streams.clear(), missing.clear(), open_words.clear()
            return made

        for batch in batches:
            key_kind = batch.schema.field(0).type
            lengths, at = pc.utf8_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0
            while at < len(lengths):
                so_far = chars + np.cumsum(lengths[at:])
                end = at + min(int(np.searchsorted(so_far, block_chars)) + 1, len(so_far))
                some = batch.slice(at, end - at)
                keys += some.column(0).to_pylist()
                streams += by_stretches(some.column(1)) if pattern in APART else map(by_words, some.column(1).to_pylist())
                chars, at = int(so_far[end - at - 1]), end
                if chars >= block_chars:
                    yield out()
                    chars = 0
        if keys:
            yield out()

    blocks = chosen.mapInArrow(lean(look_up), f"keys array<{kind}>, streams array<binary>, missing array<array<bigint>>")
    return fold.ids_each(blocks, "missing", "found")


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``folded_blocks``, 256 at a time, with the holes of their streams filled."""
    for batch in batches:
        for keys, streams, found in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
            sizes, pieces = found.values.value_lengths().to_numpy().astype(np.int64), found.values.flatten().to_numpy()
            firsts = np.cumsum(sizes) - sizes
            for at in range(0, len(streams), 256):
                some = streams[at : at + 256]
                codes = np.frombuffer(b"".join(some), "<u4")
                counts = np.ones(len(codes), np.int64)
                holes = np.flatnonzero(codes >= NONE)
                which = codes[holes].astype(np.int64) - (1 << 31)
                counts[holes] = sizes[which]
                ends = np.concatenate([[0], np.cumsum(counts)])
                flat = np.repeat(codes.astype(np.int32), counts)
                place = np.arange(sizes[which].sum()) - np.repeat(np.cumsum(sizes[which]) - sizes[which], sizes[which])
                flat[place + np.repeat(ends[holes], sizes[which])] = pieces[place + np.repeat(firsts[which], sizes[which])]
                offsets = ends[np.cumsum([0, *(len(s) // 4 for s in some)])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.values[at : at + 256], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])


def pieces_of(vocabulary_text: str) -> np.ndarray:
    """The binary piece of each id."""
    ranks = read_ranks(vocabulary_text)
    pieces = np.full(max(ranks.values()) + 1, None, object)
    for t, r in ranks.items():
        pieces[r] = t
    return pieces


def joined(codes: np.ndarray, pieces: np.ndarray) -> bytes:
    """The pieces of ``codes`` one after the other; an id that is null or that the vocabulary lacks is an error."""
    if not len(codes):
        return b""
    try:
        if codes.dtype.kind != "i" or codes.min() < 0:
            raise IndexError
        return b"".join(pieces[codes].tolist())
    except (IndexError, TypeError):
        raise ValueError("an id is not in the vocabulary") from None


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``encoded`` with ``decoded``: the bytes of ``ids`` (array of int), joined from the vocabulary's binary pieces.

    Null ids stay null, no ids give no bytes; an id that the vocabulary lacks fails the job. Bytes need not be valid
    UTF-8 where ids were cut; those of whole texts are. A column named decoded is replaced.
    """
    spec = encoded.sparkSession.sparkContext.broadcast(read_small(vocabulary))
    rows = encoded.drop("decoded")
    at = rows.columns.index("ids")
    schema = StructType([*rows.schema.fields]).add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(spec.value)
        for batch in batches:
            found = [joined(ids.values.to_numpy(zero_copy_only=False), pieces) if ids.is_valid else None for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def joined_each(ids: pa.ListArray, pieces: pa.LargeBinaryArray) -> list[memoryview]:
    """``joined`` for each of ``ids``, by one look at ``pieces``."""
    codes, ends = ids.flatten(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
    if codes.null_count or len(codes) and not 0 <= pc.min(codes).as_py() <= pc.max(codes).as_py() < len(pieces):
        raise ValueError("an id is not in the vocabulary")
    found = pieces.take(codes)
    if found.null_count:
        raise ValueError("an id is not in the vocabulary")
    if not len(found):
        return [memoryview(b"")] * len(ids)
    bounds, data = np.frombuffer(found.buffers()[1], np.int64)[ends].tolist(), memoryview(found.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def digested(batches: Iterator[pa.RecordBatch], pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows of doc_id and ids."""
    known = pa.array(pieces, pa.large_binary())
    for batch in batches:
        rows = []
        for ids, data in zip(batch.column(1), joined_each(batch.column(1), known), strict=True):
            codes = ids.values.to_numpy()
            rows.append((len(codes), hashlib.sha256(codes.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()))
        columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def decode_digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode``'s rows: decoding as ``decode`` does it, of which digests alone leave the task."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_small(vocabulary))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(lean(lambda batches: digested(batches, pieces_of(spec.value))), f"doc_id {kind}, {DIGESTS}")


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, **settings) -> DataFrame:
    """``decode_digests`` of ``encode``'s rows, which one Python worker fills, decodes and digests, so that ids do not pass through the JVM between."""
    bound = inspect.signature(encode).bind(docs, vocabulary, pattern, **settings)
    bound.apply_defaults()
    spec = docs.sparkSession.sparkContext.broadcast(read_small(vocabulary))
    kind = docs.schema[bound.arguments["key"]].dataType.simpleString()
    return folded_blocks(*bound.args).mapInArrow(lean(lambda batches: digested(filled(batches), pieces_of(spec.value))), f"doc_id {kind}, {DIGESTS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
