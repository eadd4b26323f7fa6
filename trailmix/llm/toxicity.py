"""Toxicity: restore obfuscated words by a noisy channel, then score the restored text.

A character language model is counted over the whole corpus. Spans with leetspeak, spaced letters or stretched
letters become lattices of what may have been meant; a Viterbi search takes the likeliest path. Words and word
beginnings that mark toxic rows are learnt from a bounded sample of labelled rows, on restored text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trailmix.llm.common import lean, lowest, stored, table

NAME = "op9_toxicity"
#: What a sign may stand for; fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
TRIM = ".,;:?!\"'()[]{}<>*_-~#%&"
SIGNS = re.compile(r"[a-zß-ÿ][0134578@$!|+9]|[0134578@$!|+9][a-zß-ÿ]")
STRETCH = re.compile(r"([a-zß-ÿ0-9@$])\1\1")
#: Tokens of signs only, if not a number.
SIGNS_ONLY = re.compile(r"(?=\d*[@$!|+])[0134578@$!|+9]{3,}")
#: Single letters or signs apart by blanks or punctuation, and what is between them.
SPACED = re.compile(r"(?<![\w@$|+])(?:[^\W_]|[@$!|+])(?:[\s.\-_*~,/]{1,3}(?:[^\W_]|[@$!|+])){2,}(?![\w@$|+])")
GAP = re.compile(r"[\s.\-_*~,/]+")
PREFIXES = (4, 5, 6, 7, 8)
CACHE_ENTRIES = 120_000
CLASSES = 64  # 0: edge of a word, 1-26: a-z, 27-58: letters of Latin-1, 59: digit, 60: others


def class_table() -> np.ndarray:
    t = np.full(65_536, 60, np.int32)
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[48:58] = 59
    t[97:123] = np.arange(1, 27)
    t[0xDF:0xFF] = np.arange(27, 59)
    return t


_TABLE = class_table()


def class_of(c: str) -> int:
    return int(_TABLE[min(ord(c), 65_535)])


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character-class trigrams over every whole text: at most 64**3 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    raw = np.frombuffer(f"  {t.lower()}  ".encode("utf-32-le", "replace"), "<u4")
                    k = _TABLE[np.minimum(raw, 65_535)]
                    total += np.bincount((k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "code long, n long")
    out = np.zeros(CLASSES**3, np.int64)
    for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out


class Channel:
    """Restores obfuscated tokens. ``counts`` are the trigram counts of the language model."""

    def __init__(self, counts: np.ndarray, substitution: float = 2.0, literal_sign: float = 4.0, repeat: float = 1.0, boundary: float = 3.0):
        cube = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        pair = cube.sum(axis=0)
        back = (pair + 0.1) / (pair + 0.1).sum(axis=1, keepdims=True)
        self.cost = -np.log((cube + 8 * back[None]) / (cube + 8 * back[None]).sum(axis=2, keepdims=True))
        self.substitution, self.literal_sign, self.repeat, self.boundary = substitution, literal_sign, repeat, boundary

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Per run of equal signs the (text, channel cost) choices."""
        out = []
        at = 0
        while at < len(token):
            end = at
            while end < len(token) and token[end] == token[at]:
                end += 1
            c, n = token[at], end - at
            letters = [(x, self.substitution) for x in LEET.get(c, "")] + [(c, self.literal_sign if c in LEET else 0.0)]
            lengths = [(n, 0.0)] if n < 3 else [(1, self.repeat), (2, self.repeat), *([] if n > 8 else [(n, 3 * self.repeat)])]
            out.append([(x * k, a + b) for x, a in letters for k, b in lengths])
            at = end
        return out

    def spaced_lattice(self, signs: list[str], gaps: list[tuple], split: bool) -> list[list[tuple[str, float]]]:
        """The lattice of separated signs; a gap is dropped or kept as a blank. Wider gaps than the least are rather kept, others only with ``split``."""
        out, least, at = [], min(gaps), 0
        while at < len(signs):
            if at and gaps[at - 1] > least:
                out.append([("", self.boundary), (" ", 0.0)])
            elif at and split:
                out.append([("", 0.0), (" ", self.boundary)])
            end = at + 1
            while end < len(signs) and signs[end] == signs[at] and gaps[end - 1] == least:
                end += 1
            end = end if end - at > 2 else at + 1
            out += self.lattice(signs[at] * (end - at))
            at = end
        return out

    def decode(self, token: str) -> str:
        """The likeliest meant word of a token."""
        if SIGNS_ONLY.fullmatch(token):  # all of it is meant or none, as rows of signs are frequent in some corpora
            meant = [[x for x in choices if x[0][0] not in LEET] for choices in self.lattice(token)]
            return min(self.likeliest(meant), self.likeliest([[(c, self.literal_sign)] for c in token]))[1]
        return self.likeliest(self.lattice(token))[1]

    def likeliest(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """Cost and text of the best path by Viterbi, states are the last two character classes."""
        states = {(0, 0): (0.0, None)}  # state: (cost, (text, parent))
        cost = self.cost
        for choices in [*lattice, [(" ", 0.0)]]:
            following: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (spent, chain) in states.items():
                for text, channel in choices:
                    x, y, total = a, b, spent + channel
                    for c in text:
                        z = class_of(c)
                        total += cost[x, y, z]
                        x, y = y, z
                    known = following.get((x, y))
                    if known is None or total < known[0]:
                        following[x, y] = (total, (text, chain))
            states = following
        least, chain = min(states.values(), key=lambda s: s[0])
        parts = []
        while chain is not None:
            parts.append(chain[0])
            chain = chain[1]
        return least, "".join(reversed(parts))[:-1]

    def restored(self, token: str) -> str:
        """A lower-case word without outer punctuation, decoded if it shows signs of obfuscation."""
        word = token.lower().strip(TRIM)
        if SIGNS.search(word) or STRETCH.search(word) or SIGNS_ONLY.fullmatch(word):
            return self.decode(word)
        return word

    def despaced(self, text: str) -> list[str]:
        """Words meant by runs of separated single letters: by the likeliest boundaries, and by those at wider gaps alone."""
        words: dict[str, None] = {}
        for m in SPACED.finditer(text):
            run = m.group().rstrip(TRIM + " \t\r\n")
            signs = [c.lower() for c in GAP.split(run)]
            if len(signs) < 3 or all(c.isdigit() for c in signs):
                continue
            gaps = [("\n" in g or "\r" in g, g.strip() != g, len(g)) for g in GAP.findall(run)]
            for split in (True, False):
                words |= dict.fromkeys(self.likeliest(self.spaced_lattice(signs, gaps, split))[1].split(" "))
        return [w for w in words if w]


class Words(dict):
    """Token to restored word, bounded."""

    def __init__(self, channel: Channel):
        super().__init__()
        self.channel = channel

    def __missing__(self, token: str) -> str:
        word = self.channel.restored(token)
        if len(token) < 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = word
        return word

    def of(self, text: str | None) -> set[str]:
        if not text:
            return set()
        return {self[t] for t in set(text.split())} | set(self.channel.despaced(text))


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a trailing asterisk."""
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def label_evidence(sample: DataFrame, channel) -> DataFrame:
    """(feature, label, docs) over labelled texts, counted once a document; a null feature counts the texts. Pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(channel.value), Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            made = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
                names=["feature", "toxic", "docs"],
            )
            counts.clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((f, toxic) for f in features(words.of(text)))
                counts[None, toxic] += 1
                if len(counts) > 100_000:
                    yield out()
        yield out()

    return sample.select("text", "toxic").mapInArrow(lean(run), "feature string, toxic int, docs long")


def learnt(
    docs: DataFrame, labels: DataFrame, channel, rows: int, strength: float, least: int, share: float, least_p: float, precision: float, most: int, stems: int,
) -> dict[str, float]:
    """Feature to probability that a row with it is toxic: ``least_p`` or more if it is seen in toxic rows in a share ``precision`` of cases, else less; features below the base rate are left out.

    At most ``rows`` labelled rows, those of least hash, are fitted on. The probability is shrunk to the base rate
    by ``strength`` rows; ``least`` toxic rows and a ``share`` of them must bear the feature, and a beginning must stand in ``stems``
    different words of toxic rows, else the word itself tells as much. At most ``most`` features
    are kept. Of labelled copies one counts, else all words of a much copied toxic row would look telling; copies are
    texts equal but for case and blanks, and the least text stays. Rows and the base rate are counted after that.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = lowest(marked.withColumn("drawn", F.xxhash64("doc_id")), "drawn", rows, "toxicity-sample").drop("drawn").collect()
    if not chosen:
        return {}
    schema = StructType([StructField("doc_id", LongType()), *marked.schema.fields[1:]])
    bounded = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], schema)
    copies = F.md5(F.lower(F.trim(F.regexp_replace("text", "\\s+", " "))))
    sample = docs.join(F.broadcast(bounded), "doc_id").groupBy(copies.alias("copies"), "toxic").agg(F.min("text").alias("text"))
    evidence = stored(label_evidence(sample, channel), "toxicity-evidence")
    counted = {r["toxic"] > 0: r["n"] for r in evidence.where("feature IS NULL").groupBy(F.expr("int(toxic > 0)").alias("toxic")).agg(F.sum("docs").alias("n")).collect()}
    toxic_rows = counted.get(True, 0)
    base, least = toxic_rows / max(1, sum(counted.values())), max(least, share * toxic_rows)
    toxic = F.sum(F.when(F.col("toxic") > 0, F.col("docs")).otherwise(0))
    summed = evidence.where("feature IS NOT NULL").groupBy("feature").agg(toxic.alias("bad"), F.sum("docs").alias("all"))
    p = (F.col("bad") + strength * base) / (F.col("all") + strength)
    decides = (p >= least_p) & (F.col("bad") >= precision * F.col("all"))
    seen = summed.where((F.col("bad") >= least) & (decides | (p > base))).select("feature", F.when(decides, p).otherwise(F.least(p, F.lit(0.9 * least_p))).alias("p"), "bad")
    spread = (
        evidence.where("toxic > 0 AND feature NOT LIKE '%*'").select("feature").distinct()
        .select(F.explode(F.array(*[F.when(F.length("feature") >= k, F.concat(F.substring("feature", 1, k), F.lit("*"))) for k in PREFIXES])).alias("feature"))
        .where("feature IS NOT NULL").groupBy("feature").count()
    )
    kept = seen.join(spread, "feature", "left").where(~F.col("feature").endswith("*") | (F.col("count") >= stems))
    return {r["feature"]: float(r["p"]) for r in kept.orderBy(F.desc(F.col("p") >= least_p), F.desc("bad"), "feature").limit(most).collect()}


def document_score(probabilities: list[float], threshold: float) -> float:
    """Noisy or over the words that speak for toxicity. A text without any stays below the threshold, the lower the less its most suspect word tells."""
    clean = 1.0
    hits = [p for p in probabilities if p >= threshold]
    for p in hits:
        clean *= 1.0 - p
    return 1.0 - clean if hits else 0.01 + 0.9 * (threshold - 0.01) * max(probabilities, default=0.0) / threshold


def toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = 20_000, strength: float = 10.0, least: int = 6, share: float = 0.02, precision: float = 0.7, most: int = 20_000,
    stems: int = 4, threshold: float = 0.3, folds: int = 4, held: int = 2,
) -> DataFrame:
    """All columns of ``docs`` with held_out, score (0 to 1) and predicted.

    ``labels`` (doc_id, toxic): rows of the held-out fold, crc32(doc_id) mod ``folds`` = ``held``, are never
    learnt from. Scores come from text alone. Null and empty texts score as texts without a toxic word, a null
    doc_id is in no fold, and repeated rows score alike. Without labels every text gets the low score.
    Long texts count whole; one toxic word in them decides as in a short one. Columns of the names of the
    results are replaced.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    made = ("held_out", "score", "predicted")
    context = docs.sparkSession.sparkContext
    channel = context.broadcast(Channel(character_counts(docs)))
    known = learnt(docs.select("doc_id", "text"), labels.where(fold != held).select("doc_id", "toxic"), channel, rows, strength, least, share, threshold, precision, most, stems)
    shared = context.broadcast(known)
    keep = [c for c in docs.columns if c not in made]
    schema = StructType([docs.schema[c] for c in keep])
    schema = schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, probabilities = Words(channel.value), shared.value
        strength_of: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            scores = []
            for text in texts:
                hits = []
                for w in words.of(text):
                    p = strength_of.get(w)
                    if p is None:
                        p = max((probabilities.get(f, 0.0) for f in features({w})), default=0.0)
                        if len(strength_of) >= CACHE_ENTRIES:
                            strength_of.clear()
                        strength_of[w] = p
                    if p:
                        hits.append(p)
                scores.append(document_score(hits, threshold))
            out = pa.array([i is not None and zlib.crc32(str(i).encode()) % folds == held for i in ids], pa.bool_())
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, out, pa.array(scores, pa.float64()), predicted], names=schema.names)

    return docs.select(*keep).mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
