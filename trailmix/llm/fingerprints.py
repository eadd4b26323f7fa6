"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmix.llm.common import table

NAME = "op3_document_fingerprints"
BIN_BITS = 7  # 128 bins
LOW_BITS = 8
WIDTH = 1000  # consecutive ids in a block of the successor search
BLOCK = 128
SKETCH = "array<smallint>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def with_sketch(rows: DataFrame, text: str, name: str, size: int = 5) -> DataFrame:
    """``rows`` with the low-order bits of each bin's least shingle hash; an empty array for a text without words.

    Each shingle of ``size`` words (the whole sequence, if shorter) is hashed once: the high bits name its bin,
    so the sorted hashes hold each bin's minimum where the bin changes. An empty bin takes the value of the
    filled one that a hash of both bin numbers ranks first, which is what probing bins in a random order of its
    own would reach.
    """
    shift = 63 - BIN_BITS
    words, hashes, least = f"_{name}_words", f"_{name}_hashes", f"_{name}_least"
    w = F.col(words)
    many = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + k) for k in range(size)]), 1))
    few = F.array(F.shiftrightunsigned(F.xxhash64(w), 1))
    rows = rows.withColumn(words, words_of(F.col(text)))
    rows = rows.withColumn(hashes, F.sort_array(F.when(F.size(w) >= size, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>")))).drop(words)
    h = F.col(hashes)
    rows = rows.withColumn(least, F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(h, i - 1), shift)))).drop(hashes)
    full = F.col(least)
    bins, low = 1 << BIN_BITS, F.lit((1 << LOW_BITS) - 1).cast("bigint")
    filled = f"_{name}_bins"
    rows = rows.withColumn(filled, F.transform(full, lambda x: F.shiftright(x, shift).cast("int")))

    def value(b: Column) -> Column:
        at = F.array_position(F.col(filled), b)
        donor = F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(b, F.shiftright(x, shift)).alias("rank"), x.alias("x"))))["x"]
        return F.when(at > 0, F.get(full, (at - 1).cast("int"))).otherwise(donor).bitwiseAND(low).cast("smallint")

    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), value)
    straight = F.transform(full, lambda x: x.bitwiseAND(low).cast("smallint"))
    made = F.when(F.size(full) == bins, straight).when(F.size(full) == 0, F.array().cast(SKETCH)).otherwise(every)
    return rows.withColumn(name, made).drop(least, filled)


def packed(sketch: Column) -> Column:
    """The sketch as lowercase hex, two digits a bin."""
    digits = F.array(*[F.lit(f"{v:02x}") for v in range(1 << LOW_BITS)])
    return F.array_join(F.transform(sketch, lambda v: F.get(digits, v.cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less what equal low bits owe to chance. Two texts without words are alike, one is unlike all others."""
    chance = 2.0**-LOW_BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(1 << BIN_BITS)
    worded = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(worded, F.greatest(F.lit(0.0), (same - chance) / (1 - chance))).otherwise((F.size(a) == F.size(b)).cast("double"))


def successors(keys: DataFrame, key: str) -> DataFrame:
    """(key, next_key) over distinct keys in ascending order, the greatest followed by the least.

    Blocks of WIDTH consecutive keys are ordered each by itself; only one row for WIDTH blocks meets in one place.
    """
    block = F.floor(F.col(key) / WIDTH)
    rows = keys.select(key).distinct().withColumn("_block", block)
    inside = rows.withColumn("next_key", F.lead(key).over(Window.partitionBy("_block").orderBy(key)))
    firsts = rows.groupBy("_block").agg(F.min(key).alias("first"))
    order = Window.orderBy("_block")
    following = firsts.select("_block", F.coalesce(F.lead("first").over(order), F.min("first").over(order)).alias("after"))
    return inside.join(following, "_block").select(key, F.coalesce("next_key", "after").alias("next_key"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, own) with next_text and next_own, those of the next doc_id (after the last: of the first).

    The range of ids is cut into equal blocks of some BLOCK documents on average, which are shuffled once and ordered
    within; the last document of a block takes the first of the next block from a table with one text per block. Dense
    and evenly spread (hashed) ids fill blocks alike; where most ids crowd in a small part of the range, blocks there
    are larger. Repeated ids are ordered by text. A row with a null id has no place in the order; its next text is empty.
    """
    placed = F.col("doc_id").isNotNull()
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).head()
    low, blocks = span["low"] or 0, max(1, span["n"] // BLOCK)
    width = ((span["high"] or 0) - low) // blocks + 1
    block = F.expr(f"CAST((CAST(doc_id AS DECIMAL(20, 0)) - {low}) AS DECIMAL(38, 0)) DIV {width}BD").cast("bigint")
    apart = F.lit(10**16) + F.shiftrightunsigned(F.xxhash64("text"), 1) % 10**15  # beyond any block
    rows = docs.withColumn("_part", F.when(placed, block).otherwise(apart))
    window = Window.partitionBy("_part").orderBy("doc_id", "text")
    inside = rows.withColumn("_next", F.lead(F.struct("text", "own")).over(window))
    firsts = docs.where(placed).groupBy(block.alias("_part")).agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))
    heads = with_sketch(firsts, "text", "own").select(F.col("_part").alias("next_key"), F.struct("text", "own").alias("_head"))
    tails = successors(firsts, "_part").join(heads, "next_key").select(F.col("_part").alias("_tail"), "_head")
    # joined on the window's own key, so that the texts are not shuffled again
    found = inside.join(tails, (F.col("_part") == F.col("_tail")) & F.col("_next").isNull(), "left")
    after = F.coalesce("_next", "_head")
    text, own = F.when(placed, after["text"]), F.when(placed, after["own"])
    return found.select(*docs.columns, F.coalesce(text, F.lit("")).alias("next_text"), F.coalesce(own, F.array().cast(SKETCH)).alias("next_own"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by as much of the next document's beginning. Null
    texts are empty; texts without words have an empty fingerprint. Texts shorter than a shingle are hashed
    whole. Equal texts have equal fingerprints. Extra columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, "text", "own"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.col("next_own").alias("following"), "edited", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    rows = with_sketch(rows, "edited", "changed").drop("edited")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
