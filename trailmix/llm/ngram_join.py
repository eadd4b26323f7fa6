"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is the set of hashes of its word n-grams; documents of equal sets are one class. Two sets of Jaccard
similarity t or more share one of the first |x| - ceil(t |x|) + 1 tokens of each, whatever the order of all tokens,
so a pair is a candidate only if it shares such a prefix token under every order. The orders put tokens known to be
frequent last (the first order only, as these decide least) and the others in the order of differently seeded hashes.
Prefixes of the first order are longer by some tokens, and pairs must share as many more.

1. Sets meet in the prefix groups of the first order. There each meets one leader, the set nearest to what the group
   has in common, so that a family of near copies has one leader and gives a row per set, not per pair.
2. Pairs that share a prefix token under each further order too, and whose bitmaps allow it, are verified on whole
   sets. A set of half a leader's tokens or more becomes a member of its family and is kept as its difference from it.
3. Two members of a family that are not both similar to the leader must share a good part of their differences, so
   they meet by prefixes of these, tokens that the leader lacks first. Similar families stay linear thereby.
4. Sets of different leaders meet in prefix groups, those of a group's main leader only with the others.
Pairs that are linked by then are not looked at again; 2 holds for 4 as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.llm.bits import bit_table, members, power_for
from trailmix.llm.common import lean, stored, table
from trailmix.llm.components import components
from trailmix.llm.shingling import Words, grams, mixed, portions

NAME = "op1_ngram_jaccard_join"
PORTION, LEAST = 1_000_000, 3
PARITY = 384
#: A set joins a leader's family from this percentage of similarity on.
LOOSE = 50
#: Rows of a prefix group that one task looks at together; a longer group has a leader for every so many rows.
BLOCK = 20_000
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
NO_FREQUENT = (np.empty(0, np.uint64), np.empty(0, np.uint64))


class Sets:
    """Token sets of a list of texts: per text a sorted array, and a hash of the whole set as its class."""

    def __init__(self, texts: list[str | None], size: int):
        words = Words(texts, lower=True)
        all_grams, self.tokens = grams(words.hashes, size), []
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if b - a >= size:
                self.tokens.append(np.unique(all_grams[a : b - size + 1]))
            else:
                self.tokens.append(grams(words.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
        place = np.uint64(0x9E3779B97F4A7C15)
        self.classes = np.array([mixed(np.array([mixed(t * place + np.uint64(len(t))).sum()], np.uint64))[0] for t in self.tokens], np.uint64).reshape(-1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def read_set(data) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def views(column: pa.Array) -> Iterator[memoryview]:
    """The values of a binary column without nulls, not copied."""
    if len(column):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        for a, b in zip(ends, ends[1:]):
            yield whole[a:b]


def needed(n):
    """How many tokens of the first order's prefixes a set of ``n`` tokens must share with any partner as large or larger."""
    return 1 + n // 50


def prefix(tokens: np.ndarray, order: int, percent: int, frequent: np.ndarray, ranks: np.ndarray, least: int = 1) -> np.ndarray:
    """The tokens of the set that come first in the order; enough of them for any partner to share ``least``."""
    n = len(tokens)
    keys = mixed(tokens ^ np.uint64(SEEDS[order])) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        keys = np.where(frequent[at] == tokens, np.uint64(1 << 63) + ranks[at], keys)
    length = n - -(-percent * n // 100) + least
    return tokens[np.argsort(keys)[:length]] if length < n else tokens


def parity(tokens: np.ndarray, width: int = PARITY) -> np.ndarray:
    """Bit i: whether an odd number of tokens fall on it. The bits in which two sets differ are at most the tokens in which they do."""
    return np.packbits(np.bincount((tokens >> np.uint64(20)).astype(np.int64) % width, minlength=width) & 1)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity bits twice as many as the tokens, rounded up to a power of two: a finer bitmap."""
    return parity(tokens, max(64, 2 << (len(tokens) - 1).bit_length()) if len(tokens) else 64).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer is folded to the other's width."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


WORDS = [f"p{k}" for k in range(PARITY // 64)]
PARITY_TYPE = ", ".join(f"{w} long" for w in WORDS)


def near(n: np.ndarray, bits: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of sizes ``n`` may be similar to those of sizes ``m``: differ <= n + m - 2 both and 100 both >= percent (n + m - both)."""
    differ = np.bitwise_count((bits ^ other).view(np.uint64)).sum(axis=1).astype(np.int64)
    return differ * (100 + percent) <= (n.astype(np.int64) + m) * (100 - percent)


def may_link(x: str, y: str, percent: int) -> Column:
    """The same test, and that of sizes, on rows aliased ``x`` and ``y``."""
    differ = " + ".join(f"bit_count({x}.{w} ^ {y}.{w})" for w in WORDS)
    like = f"100L * {x}.n >= {percent} * {y}.n AND 100L * {y}.n >= {percent} * {x}.n"
    return F.expr(f"{like} AND ({differ}) * {100 + percent}L <= ({x}.n + {y}.n) * {100 - percent}L")


def like_size(groups: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Per row the end of the rows of its group that are at most 100 / percent times as large; rows ascend by group and n."""
    key = groups.astype(np.int64) << 32
    return np.searchsorted(key + n, key + 100 * n.astype(np.int64) // percent, "right")


def windows(groups: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """First rows of the windows of like size into which every group falls."""
    ends = like_size(groups, n, percent)
    starts, at = [], np.unique(groups, return_index=True)[1]
    limits = np.append(at[1:], len(groups))
    while len(at):
        starts.append(at)
        at = ends[at]
        at, limits = at[at < limits], limits[at < limits]
    return np.sort(np.concatenate(starts))


def leaders(first: np.ndarray, classes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Per row the row that leads its window: the nearest to the window's majority in each bit, ties by a hash of the class."""
    window = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(classes))))
    plain = np.unpackbits(bits.view(np.uint8), axis=1)
    counts = np.add.reduceat(plain, first, axis=0, dtype=np.int32)
    sizes = np.diff(np.append(first, len(classes)))
    common = np.packbits(2 * counts > sizes[:, None], axis=1)
    distance = np.bitwise_count(bits.view(np.uint8) ^ common[window]).sum(axis=1, dtype=np.int64)
    order = np.lexsort((mixed(classes.view(np.uint64)), distance, window))
    return order[first][window]


def bounds(n: int, percent: int) -> int:
    """The most tokens in which a set of ``n`` tokens differs from any similar set."""
    return n * (100 - percent) // percent


def asked(differences: int, n: int, percent: int) -> int:
    """How many first tokens of a member's difference from its leader meet others.

    Let x be a member that is not similar to the leader p, y another, d their differences from p, o what these share.
    x and y differ by d(x) + d(y) - 2 o, at most r (n(x) + n(y)) if they are similar, r = (100 - percent) / (100 + percent),
    and d(x) > r (n(x) + n(p)), d(y) >= |n(y) - n(p)|, so 2 o > (1 - r) d(y). Also d(x) >= d(y) - bound, so that
    o >= d(y) - bound, which holds for x as well.
    """
    return differences - max(differences * percent // (100 + percent) + 1, differences - bounds(n, percent)) + 1


class Join:
    def __init__(self, docs: DataFrame, percent: int = 80, size: int = 5, orders: int = 3, frequent: int = 50_000):
        self.docs, self.percent, self.size, self.orders, self.most = docs, percent, size, orders, frequent
        self.spark = docs.sparkSession

    def described_rows(self) -> DataFrame:
        """One pass over the texts: doc_id, class and n of every row, with the set where a task first meets the class; and, with a token, how many sets of a portion hold it where ``LEAST`` do."""
        size = self.size
        names = ["doc_id", "class", "n", "tokens", "token"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[int] = set()
            for batch in batches:
                ids, texts = (c.to_pylist() for c in batch.columns)
                for a, b in portions(texts, PORTION):
                    sets = Sets(texts[a:b], size)
                    if len(done) > 200_000:
                        done.clear()
                    fresh = []
                    for c, t in zip(sets.classes.tolist(), sets.tokens, strict=True):
                        fresh.append(t if len(t) and c not in done else None)
                        done.add(c)
                    data = pa.array([None if t is None else t.astype("<u8").tobytes() for t in fresh], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), signed(sets.classes), pa.array([len(t) for t in sets.tokens], pa.int64()), data, pa.nulls(b - a, pa.int64())], names=names)
                    kept = [t for t in fresh if t is not None]
                    if kept:
                        found, n = np.unique(np.concatenate(kept), return_counts=True)
                        often = n >= LEAST
                        some = int(often.sum())
                        none = pa.nulls(some, pa.int64())
                        yield pa.RecordBatch.from_arrays([none, none, pa.array(n[often].astype(np.int64)), pa.nulls(some, pa.binary()), signed(found[often])], names=names)

        return stored(self.docs.mapInArrow(lean(run), "doc_id long, class long, n long, tokens binary, token long"), "join-rows")

    def frequent(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent tokens, sorted, and their ranks from the rarest up: all of the count classes (an eighth of a power of two each) that hold at most ``most`` of them. Any choice is a valid order; this one keeps prefix groups small."""
        counted = stored(rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")), "join-frequent")
        step = F.floor(F.log2("n") * 8).cast("int")
        classes = {r["step"]: r["count"] for r in counted.groupBy(step.alias("step")).count().collect()}
        total, least = 0, 512
        for c in sorted(classes, reverse=True):
            total += classes[c]
            if total > self.most:
                break
            least = c
        found = sorted(((r["n"], -r["token"]) for r in counted.where(step >= least).collect()), reverse=True)
        tokens = np.array([-t for _, t in found], np.int64).view(np.uint64)
        ranks = np.arange(len(found), dtype=np.uint64)[::-1]
        sort = np.argsort(tokens)
        return tokens[sort], ranks[sort]

    def prefixes(self, sets: DataFrame, hot, power: int) -> DataFrame:
        """(class, n, parity words, shared) where ``shared`` are the recurring prefix tokens of the set under the first order. Sets without have no partner."""
        percent = self.percent

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [prefix(t, 0, percent, *hot.value, needed(len(t))) for t in map(read_set, views(batch.column(2)))]
                if kept:
                    found, n = np.unique(np.concatenate(kept), return_counts=True)
                    yield pa.RecordBatch.from_arrays([signed(found), pa.array(n.astype(np.int64))], names=["token", "n"])

        counted = sets.mapInArrow(lean(first), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        known = self.spark.sparkContext.broadcast(bit_table(counted.where("n > 1"), "token", power))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared, bits, keep = [], [], []
                for i, tokens in enumerate(map(read_set, views(batch.column(2)))):
                    some = prefix(tokens, 0, percent, *hot.value, needed(len(tokens)))
                    some = some[members(known.value, some)]
                    if len(some):
                        keep.append(i)
                        shared.append(some.view(np.int64))
                        bits.append(parity(tokens).view(np.int64))
                if keep:
                    words, chosen = np.array(bits), pa.array(keep)
                    columns = [batch.column(0).take(chosen), batch.column(1).take(chosen), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(WORDS)))]
                    offsets = pa.array(np.cumsum([0, *map(len, shared)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(shared)))], names=["class", "n", *WORDS, "shared"])

        rows = sets.mapInArrow(lean(emit), f"class long, n long, {PARITY_TYPE}, shared array<long>")
        return stored(rows.dropDuplicates(["class"]), "join-prefixes")

    def led(self, prefixes: DataFrame) -> DataFrame:
        """(a, b): each class b with the leader a that it meets in most of its prefix groups, if these are an eighth of its prefix."""
        percent = self.percent
        names = ["token", "class", "n", *WORDS]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []

            def out() -> Iterator[pa.RecordBatch]:
                if not held:
                    return
                token, classes, n, *words = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                bits = np.ascontiguousarray(np.column_stack(words))
                leader = leaders(windows(np.cumsum(np.append(0, token[1:] != token[:-1])), n, percent), classes, bits)
                some = np.flatnonzero(leader != np.arange(len(n)))
                some = some[near(n[some], bits[some], n[leader[some]], bits[leader[some]], LOOSE)]
                yield pa.RecordBatch.from_arrays([pa.array(classes[leader[some]]), pa.array(classes[some]), pa.array(n[some])], names=["a", "b", "n"])

            rows = 0
            for batch in batches:
                columns = tuple(c.to_numpy() for c in batch.columns)
                while len(columns[0]):
                    token = columns[0]
                    # whole groups while they fit a block; a group that is longer is cut
                    end = min(len(token), BLOCK - rows)
                    if end < len(token):
                        start = int(np.searchsorted(token, token[end]))
                        end = start if start or rows else end
                    if end:
                        held.append(tuple(c[:end] for c in columns))
                        rows += end
                    if end < len(token):
                        yield from out()
                        rows = 0
                    columns = tuple(c[end:] for c in columns)
            yield from out()

        rows = prefixes.select(F.explode("shared").alias("token"), "class", "n", *WORDS)
        # dealt by ranges of (token, n), so a token in very many sets is spread over tasks
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(partitions, "token", "n", "class").sortWithinPartitions("token", "n", "class").select(*names)
        counted = dealt.mapInArrow(lean(run), "a long, b long, n long").groupBy("a", "b", "n").count().where(f"800 * count >= {100 - percent} * n")
        return stored(counted.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b"), "join-led")

    def described(self, sets: DataFrame, pairs: DataFrame, describe, name: str) -> DataFrame:
        """(class, n, ``name``) for the classes in ``pairs``; a bit table keeps most others back."""
        wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b"))
        known = self.spark.sparkContext.broadcast(bit_table(wanted, "class", power_for(16 * pairs.count())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keep = pa.array(members(known.value, batch.column(0).to_numpy().view(np.uint64)))
                    data = [describe(t) for t in map(read_set, views(batch.column(2).filter(keep)))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(data, pa.binary())], names=["class", "n", name])

        return sets.mapInArrow(lean(run), f"class long, n long, {name} binary").dropDuplicates(["class"])

    def attached(self, pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        left = facts.toDF("a", "a_n", f"a_{name}")
        right = facts.toDF("b", "b_n", f"b_{name}")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "b_n", f"a_{name}", f"b_{name}")

    def supported(self, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
        """Pairs that share a prefix token under each further order as well, and whose sketches allow similarity ``percent``. No whole set is fetched for others."""
        orders, least = self.orders, self.percent

        def describe(tokens: np.ndarray) -> bytes:
            # of each token 32 bits: chance equality lets a pair pass, none is lost
            parts = [np.sort(prefix(tokens, k, least, *NO_FREQUENT) >> np.uint64(32)).astype("<u4").tobytes() for k in range(1, orders)]
            return b"".join([*(len(x).to_bytes(4, "little") + x for x in parts), sketch(tokens)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a_n, b_n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), views(batch.column(4)), views(batch.column(5)), strict=True):
                    at, to, fits = 0, 0, True
                    for _ in range(1, orders):
                        i, j = (int.from_bytes(z[k : k + 4], "little") for z, k in ((x, at), (y, to)))
                        fits = fits and len(np.intersect1d(np.frombuffer(x, "<u4", i // 4, at + 4), np.frombuffer(y, "<u4", j // 4, to + 4))) > 0
                        at, to = at + 4 + i, to + 4 + j
                    keep.append(fits and differing(x[at:], y[to:]) * (100 + percent) <= (a_n + b_n) * (100 - percent))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        return stored(self.attached(pairs, self.described(sets, pairs, describe, "support"), "support").mapInArrow(lean(run), "a long, b long"), "join-supported")

    def families(self, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        """(a, b, n, linked, lacks, difference, parity words) of b in the family of a: the tokens that the leader lacks (``lacks`` many), then those that b lacks."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for i, (x, y) in enumerate(zip(views(batch.column(4)), views(batch.column(5)), strict=True)):
                    lead, own = read_set(x), read_set(y)
                    more, less = np.setdiff1d(own, lead, assume_unique=True), np.setdiff1d(lead, own, assume_unique=True)
                    both = len(own) - len(more)
                    if 100 * both >= LOOSE * (len(lead) + len(more)):
                        rows.append((i, 100 * both >= percent * (len(lead) + len(more)), len(more), more.tobytes() + less.tobytes(), parity(own).view(np.int64)))
                if rows:
                    keep, words = pa.array([r[0] for r in rows]), np.array([r[4] for r in rows])
                    columns = [batch.column(k).take(keep) for k in (0, 1, 3)] + [pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(WORDS)))], names=["a", "b", "n", "linked", "lacks", "difference", *WORDS])

        facts = self.described(sets, pairs, lambda t: t.tobytes(), "tokens")
        return stored(self.attached(pairs, facts, "tokens").mapInArrow(lean(run), f"a long, b long, n long, linked boolean, lacks long, difference binary, {PARITY_TYPE}"), "join-families")

    def within(self, families: DataFrame, labels: DataFrame) -> DataFrame:
        """Linked pairs of members of one family that have different labels."""
        percent = self.percent
        loose = families.where("NOT linked").select("a").distinct()
        rows = families.join(loose, "a", "left_semi").join(labels.toDF("b", "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
        rows = rows.select("a", "b", "n", "linked", "lacks", "difference", "label", *WORDS)
        carried = ["a", "b", "n", "linked", "label", *WORDS]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, tokens, probes, sizes = [], [], [], []
                values = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
                for i, (n, linked, lacks, data) in enumerate(values):
                    d = read_set(data)
                    order = np.concatenate([np.argsort(mixed(d[:lacks])), lacks + np.argsort(mixed(d[lacks:]))]).astype(np.int64)
                    some = min(len(d), asked(len(d), n, percent))
                    all_ = some if linked else max(some, min(len(d), bounds(n, percent) + 1))
                    tokens.append(d[order[:all_]])
                    probes.append(np.arange(all_) < some)
                    sizes.append(np.full(all_, len(d)))
                    at.append(np.full(all_, i))
                if at:
                    chosen = pa.array(np.concatenate(at))
                    columns = [batch.column(batch.schema.get_field_index(c)).take(chosen) for c in carried]
                    yield pa.RecordBatch.from_arrays([*columns, signed(np.concatenate(tokens)), pa.array(np.concatenate(probes)), pa.array(np.concatenate(sizes).astype(np.int64))], names=[*carried, "token", "probe", "d"])

        met = stored(rows.mapInArrow(lean(emit), f"a long, b long, n long, linked boolean, label long, {PARITY_TYPE}, token long, probe boolean, d long"), "join-differences")
        x, y = met.where("NOT linked").alias("x"), met.where("probe").alias("y")
        once = "x.a = y.a AND x.token = y.token AND x.label <> y.label AND (y.linked OR x.b < y.b OR NOT x.probe)"
        pairs = x.join(y, F.expr(once) & may_link("x", "y", percent)).select(F.col("x.a").alias("a"), F.least("x.b", "y.b").alias("b"), F.greatest("x.b", "y.b").alias("c")).distinct()

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for n, m, d, e in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                    d, e = read_set(d), read_set(e)
                    apart = len(d) + len(e) - 2 * len(np.intersect1d(d, e, assume_unique=True))
                    keep.append(apart * (100 + percent) <= (n + m) * (100 - percent))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        facts = families.select("a", "b", "n", "difference")
        both = pairs.join(facts, ["a", "b"]).join(facts.toDF("a", "c", "m", "other"), ["a", "c"])
        return stored(both.select("b", "c", "n", "m", "difference", "other").mapInArrow(lean(verify), "a long, b long"), "join-within")

    def across(self, prefixes: DataFrame, families: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs a < b of different leaders and labels and of like size that share enough prefix tokens and may be near by their bitmaps."""
        rows = prefixes.join(families.select(F.col("b").alias("class"), F.col("a").alias("leader")), "class", "left").join(labels.toDF("class", "label"), "class", "left")
        rows = stored(rows.withColumns({"leader": F.coalesce("leader", "class"), "label": F.coalesce("label", "class")}), "join-led-prefixes")
        counted = rows.select(F.explode("shared").alias("token"), "leader").groupBy("token", "leader").count()
        main = counted.groupBy("token").agg(F.max_by("leader", F.struct("count", "leader")).alias("main"), F.count("*").alias("_leaders"))
        main = stored(main.where("_leaders > 1").drop("_leaders"), "join-main-leaders")
        known = self.spark.sparkContext.broadcast(bit_table(main, "token", power_for(16 * main.count())))
        carried = ["class", "n", "leader", "label", *WORDS]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(batch.num_columns - 1)
                tokens = lists.flatten().to_numpy()
                keep = members(known.value, tokens.view(np.uint64))
                at = pa.array(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[keep])
                yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), *(batch.column(k).take(at) for k in range(batch.num_columns - 1))], names=["token", *carried])

        met = rows.select(*carried, "shared").mapInArrow(lean(emit), f"token long, class long, n long, leader long, label long, {PARITY_TYPE}").join(main, "token")
        x, y = met.where("leader <> main").alias("x"), met.alias("y")
        once = "x.token = y.token AND x.leader <> y.leader AND x.label <> y.label AND (y.leader = y.main OR x.class < y.class)"
        found = x.join(y, F.expr(once) & may_link("x", "y", self.percent)).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"), F.least("x.n", "y.n").alias("n"))
        found = found.groupBy("a", "b", "n").count().where("count >= 1 + n div 50")
        return stored(found.select("a", "b"), "join-candidates")

    def verified(self, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        """Pairs of similarity ``percent`` or more on whole sets."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a_n, b_n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), views(batch.column(4)), views(batch.column(5)), strict=True):
                    both = len(np.intersect1d(read_set(x), read_set(y), assume_unique=True))
                    keep.append(100 * both >= percent * (a_n + b_n - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        facts = self.described(sets, pairs, lambda t: t.tobytes(), "tokens")
        return stored(self.attached(pairs, facts, "tokens").mapInArrow(lean(run), "a long, b long"), "join-links")

    def run(self) -> DataFrame:
        rows = self.described_rows()
        sets = rows.where("tokens IS NOT NULL").select("class", "n", "tokens")
        described = rows.where("token IS NULL").select("doc_id", "class", "n")
        hot = self.spark.sparkContext.broadcast(self.frequent(rows))
        total = sets.agg(F.sum("n")).head()[0] or 0
        prefixes = self.prefixes(sets, hot, power_for(total * (100 - self.percent) // 100))
        families = self.families(sets, self.supported(sets, self.led(prefixes), LOOSE))
        links = families.where("linked").select("a", "b")
        labels = components(links)
        links = stored(links.union(self.within(families, labels)), "join-links")
        labels = components(links)
        more = self.verified(sets, self.supported(sets, self.across(prefixes, families, labels), self.percent))
        # links between families are links between their labels, and many are the same
        left, right = labels.toDF("a", "x"), labels.toDF("b", "y")
        joined = more.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct()
        final = components(joined).toDF("label", "final")
        least = described.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
        classes = least.join(labels.toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        classes = classes.join(final, "label", "left").select("class", "least", F.coalesce("final", "label").alias("label"))
        smallest = classes.groupBy("label").agg(F.min("least").alias("component"))
        named = classes.join(smallest, "label").select("class", "component")
        return described.join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def linked(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id per row of ``docs`` (doc_id, text).

    Rows link when their sets of ``size``-word shingles have ``percent`` of their union in common or more; a
    component's id is its smallest doc_id. Null, empty and blank texts have empty sets and stand alone; texts of fewer
    words than ``size`` are one token. A null doc_id may link others but names no component. Repeated rows and ids are
    rows of their own. Extra columns are left out. Tokens and classes are 64-bit hashes: among ten billion different
    sets some two pairs are expected to share a class by chance.
    """
    return Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), percent, size).run()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), percent=85, size=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
      FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS v FROM n UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(root) AS component FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = w.doc_id
"""
