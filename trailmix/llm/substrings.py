"""Substring dedup: repeated-phrase automata find passages whose words stand earlier in the corpus.

1. Every window of WINDOW words is named by its minimizer, the least hash of its phrases of PHRASE words. Minimizers
   that occur twice or more in the corpus are counted exactly; a bit table of bounded size carries them to the scan.
2. The scan cuts out the regions around such phrases. Windows repeated within a portion of the scan are settled there,
   their words compared; the first of each goes with its region to the shard of its phrase.
3. A shard confirms the phrases that several regions have, compiles them into an Aho-Corasick automaton, streams its
   regions through it, and compares the windows around each located phrase word by word.
4. Word ranges to remove return to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.llm.bits import bit_table, members, power_for
from trailmix.llm.common import lean, stored, table
from trailmix.llm.shingling import Words, grams, least_over, portions

NAME = "op6_substring_dedup"
WINDOW = 20
PHRASE = 8
BITS = 64
PORTION = 1_000_000
FIRST = -(1 << 63)


class Windows:
    """Windows of a list of texts that lie within one text: place of the first word, hash, minimizer, text, start in it."""

    def __init__(self, texts: list[str | None]):
        self.words = w = Words(texts)
        counts = np.diff(w.bounds)
        usable = np.maximum(counts - WINDOW + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), usable)
        self.start = np.arange(usable.sum()) - np.repeat(np.cumsum(usable) - usable, usable)
        self.at = w.bounds[self.text] + self.start
        if len(self.at):
            self.phrases = grams(w.hashes, PHRASE)
            self.least = least_over(self.phrases, WINDOW - PHRASE + 1)[self.at]
            self.hash = grams(w.hashes, WINDOW)[self.at]
        else:
            self.phrases = self.least = self.hash = np.empty(0, np.uint64)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its place in the order (a null id comes first) and a key that tells texts of equal ids apart."""
    return docs.withColumn("_order", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))).withColumn("_key", F.xxhash64("text"))


def recurring_bits(docs: DataFrame) -> np.ndarray:
    """A table of BITS bits a member that has the bit of every minimizer found at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in portions(texts, PORTION):
                v = Windows(texts[a:b])
                if not len(v.least):
                    continue
                fresh = np.ones(len(v.least), bool)
                fresh[1:] = (v.least[1:] != v.least[:-1]) | (v.text[1:] != v.text[:-1])
                # a run of windows on one minimizer is one place, unless windows in it are equal
                found, n = np.unique(v.least[fresh], return_counts=True)
                _, back, times = np.unique(v.hash, return_inverse=True, return_counts=True)
                again = np.isin(found, v.least[times[back] > 1])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.maximum(n, 1 + again).astype(np.int64))], names=["least", "n"])

    counted = docs.select("text").mapInArrow(lean(run), "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    again = stored(counted.where("n > 1").select("least"), "substring-recurring")
    return bit_table(again, "least", power_for(BITS * again.count()))


def runs(flags_break: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) of the runs that begin where the flag is set."""
    first = np.flatnonzero(flags_break)
    return first, np.append(first[1:], len(flags_break))


PIECES = "order_id long, key long, lo int, hi int, least long, at int, words binary"


def pieces(v: Windows, asked: np.ndarray, orders: list[int], keys: list[int]) -> list[list]:
    """Columns of PIECES for the windows ``asked``: windows that stand earlier in the same texts are settled, the others become regions around their phrase.

    Windows of equal hashes are compared word by word, a run at a time; a run whose words differ from its leader's is not settled.
    """
    text, start, place = v.text[asked], v.start[asked], v.at[asked]
    least, window = v.least[asked], v.hash[asked]
    order = np.array(orders, np.int64)[text]
    sort = np.lexsort((start, order, window))
    head = np.ones(len(sort), bool)
    head[1:] = window[sort][1:] != window[sort][:-1]
    leader = np.empty(len(sort), np.int64)
    leader[sort] = sort[np.flatnonzero(head)[np.cumsum(head) - 1]]
    again = (order > order[leader]) | (start > start[leader])
    first = place[leader]
    cut = np.ones(len(asked), bool)
    cut[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1) | (again[1:] != again[:-1]) | (~again[1:] & (least[1:] != least[:-1])) | (again[1:] & (first[1:] != first[:-1] + 1))
    rows: list[list] = [[] for _ in range(7)]
    last = (-1, -1)  # text and end of the range that was settled last

    def same(p: int, q: int, n: int) -> bool:
        """Whether ``n`` words are the same from two places; equal bytes are split alike."""
        w = v.words
        return w.data[w.starts[p] : w.ends[p + n - 1]] == w.data[w.starts[q] : w.ends[q + n - 1]] or w.text(p, p + n) == w.text(q, q + n)

    def add(i: int, j: int, settled: bool) -> None:
        nonlocal last
        t, lo, hi = int(text[i]), int(start[i]), int(start[j - 1]) + 1
        if settled and last == (t, lo):  # goes on where the last range ends, after another leader
            rows[3][-1] = hi
            last = (t, hi)
            return
        last = (t, hi) if settled else (-1, -1)
        row = (orders[t], keys[t], lo, hi, None, None, None)
        if not settled:
            p = int(place[i])
            phrase = int(np.argmax(v.phrases[p : p + hi - lo + WINDOW - PHRASE] == least[i]))
            row = (*row[:4], int(least[i].view(np.int64)), phrase, v.words.text(p, p + hi - lo + WINDOW - 1))
        for column, value in zip(rows, row, strict=True):
            column.append(value)

    for i, j in zip(*runs(cut), strict=True):
        if not again[i]:
            add(i, j, False)
            continue
        if same(int(place[i]), int(first[i]), int(j - i) + WINDOW - 1):
            add(i, j, True)
        else:
            for k in range(i, j):
                add(k, k + 1, same(int(place[k]), int(first[k]), WINDOW))
    return rows


def scanned(docs: DataFrame, bits) -> DataFrame:
    """Rows of two kinds: windows lo to hi (exclusive) settled as repeated (words is null), and regions to be resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            orders, keys, texts = (c.to_pylist() for c in batch.columns)
            for a, b in portions(texts, PORTION):
                v = Windows(texts[a:b])
                asked = np.flatnonzero(members(known, v.least))
                if not len(asked):
                    continue
                rows = pieces(v, asked, orders[a:b], keys[a:b])
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["order_id", "key", "lo", "hi", "least", "at", "words"])

    return docs.select("_order", "_key", "text").mapInArrow(lean(run), PIECES)


class Shard:
    """Streams regions that come ordered by phrase, document and start; gives the windows that stood earlier."""

    def __init__(self):
        self.least, self.seen = None, {}

    def resolve(self, rows: list[tuple]) -> Iterator[tuple]:
        """rows: (order, key, lo, least, at, words). Yields (order, key, lo, hi) of repeated windows."""
        automaton = ahocorasick.Automaton()
        several = {r[3] for r, s in zip(rows, rows[1:]) if r[3] == s[3]} | {rows[-1][3], self.least}
        for r in rows:
            if r[3] in several:
                phrase = b" ".join(r[5].split(b" ")[r[4] : r[4] + PHRASE]).decode()
                automaton.add_word(f" {phrase} ", (r[3], phrase))
        automaton.make_automaton()
        for order, key, lo, least, _, words in rows:
            if least != self.least:
                self.least, self.seen = least, {}
            if least not in several:
                continue
            text, parts = f" {words.decode()} ", words.split(b" ")
            begun = None
            for i in self.around(automaton, text, least, len(parts)):
                window = b" ".join(parts[i : i + WINDOW])
                first = self.seen.setdefault(window, (order, lo + i))
                if first >= (order, lo + i):
                    if begun is not None:
                        yield order, key, *begun
                    begun = None
                elif begun is not None and begun[1] == lo + i:
                    begun = (begun[0], lo + i + 1)
                else:
                    if begun is not None:
                        yield order, key, *begun
                    begun = (lo + i, lo + i + 1)
            if begun is not None:
                yield order, key, *begun

    @staticmethod
    def around(automaton, text: str, least: int, words: int) -> list[int]:
        """Windows of a region that hold an occurrence of its phrase, as the automaton locates them."""
        found: set[int] = set()
        for end, (owner, phrase) in automaton.iter(text):
            if owner == least:
                at = text.count(" ", 0, end - len(phrase)) - 1  # words before the occurrence
                found.update(range(max(0, at + PHRASE - WINDOW), min(at, words - WINDOW) + 1))
        return sorted(found)


def resolved(regions: DataFrame, rows: int = 20_000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(), []

        def out() -> pa.RecordBatch:
            found = list(shard.resolve(held))
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=["order_id", "key", "lo", "hi"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= rows:
                    yield out()
        if held:
            yield out()

    dealt = regions.select("order_id", "key", "lo", "least", "at", "words")
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "least").sortWithinPartitions("least", "order_id", "lo")
    return dealt.mapInArrow(lean(run), "order_id long, key long, lo int, hi int")


def removals(docs: DataFrame) -> DataFrame:
    """(order_id, key, ranges): per document the windows, as packed pairs of int32, whose words stand earlier."""
    bits = docs.sparkSession.sparkContext.broadcast(recurring_bits(docs))
    pieces = stored(scanned(docs, bits), "substring-pieces")
    bits.unpersist()
    late = resolved(pieces.where("words IS NOT NULL"))
    both = pieces.where("words IS NULL").select("order_id", "key", "lo", "hi").unionByName(late)
    return both.groupBy("order_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept_text: the words left, joined by one blank.

    A word goes if a window of WINDOW words over it also starts earlier: in a smaller doc_id, or in the same
    document before. A null doc_id comes before all others; rows of equal ids are one document to that rule, each
    keeping its own text, so that full copies of a row are treated alike. Null, empty and short texts lose
    nothing. One text is held whole in memory. Columns of the names of the results are replaced.
    """
    made = ("n_words", "n_removed", "kept_text")
    keep = [c for c in docs.columns if c not in made]
    rows = keyed(docs.select(*keep))
    found = removals(rows.select("_order", "_key", "text")).toDF("_of_order", "_of_key", "_ranges")
    matched = rows.join(found, (F.col("_order") == F.col("_of_order")) & (F.col("_key") == F.col("_of_key")), "left").select(*keep, "_ranges")
    schema = docs.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            results = []
            for text, ranges in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for r in ranges:
                        edge[r["lo"]] += 1
                        edge[r["hi"] + WINDOW - 1] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                results.append((len(words), len(words) - len(left), b" ".join(left).decode()))
            columns = [pa.array([r[k] for r in results], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return matched.mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS i)),
marked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM marked, LATERAL (SELECT unnest(range(i, i + 20)) AS p) WHERE again),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
