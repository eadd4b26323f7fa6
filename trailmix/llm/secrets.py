"""Secret scans: a trigram inverted index names the candidates of each rule, its regex verifies them. Built-in functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.llm.common import stored, table

NAME = "op5_secret_scans"
SHARD = 4096
#: Candidates of up to so many documents are broadcast: some hundred bytes each.
BROADCAST_ROWS = 100_000
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read alike in Java and Python; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed patterns. The base kinds come first and in this order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that have 16 characters
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def literal_ways(items) -> list[list[str]]:
    """Ways to match a parsed regex, each as the literal runs that any match of that way contains; a gap splits runs."""
    ways = [[""]]
    for op, value in items:
        if op is sre.LITERAL:
            options = [[chr(value)]]
        elif op is sre.IN and len(value) <= 8 and all(o is sre.LITERAL for o, _ in value):
            options = [[chr(v)] for _, v in value]
        elif op is sre.BRANCH:
            options = [w for branch in value[1] for w in literal_ways(branch)]
        elif op is sre.SUBPATTERN:
            options = literal_ways(value[3])
        elif op is sre.MAX_REPEAT and value[:2] == (0, 1) and len(value[2]) == 1 and value[2][0][0] is sre.LITERAL:
            options = [[chr(value[2][0][1])], [""]]
        else:
            options = [["", ""]]
        ways = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in ways for b in options]
        if len(ways) > 256:
            return [[""]]
    return ways


def trigram_query(pattern: str) -> list[list[str]] | None:
    """The regex's Boolean trigram query on lower-case text, as alternatives of required trigrams; None if none are mandatory."""
    ways = []
    for runs in literal_ways(parser.parse(pattern)):
        grams = {r[i : i + 3].lower() for r in runs for i in range(len(r) - 2)}
        if not grams:
            return None
        ways.append(sorted(grams))
    return [list(w) for w in sorted({tuple(w) for w in ways})]


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """doc_id with the numbers of the rules whose trigram queries it meets, from posting lists; None if every rule scans fully.

    The index holds the trigrams that the rules ask for, and posts each (trigram, doc_id) once, in shards of
    ``SHARD`` consecutive ids, so that no list grows with the corpus. Lists are intersected within a shard.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    if not queries:
        return None
    grams = sorted({g for q in queries.values() for way in q for g in way})
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    postings = keyed.select("doc_id", F.explode(found).alias("gram"))
    shard = F.floor(F.col("doc_id") / SHARD)
    lists = postings.groupBy(shard.alias("shard")).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("gram") == k, F.col("doc_id")))).alias(f"g{k}") for k in range(len(grams))]
    )

    def met(query: list[list[str]]) -> Column:
        union = None
        for way in query:
            both = None
            for g in way:
                ids = F.col(f"g{grams.index(g)}")
                both = ids if both is None else F.array_intersect(both, ids)
            union = both if union is None else F.array_union(union, both)
        return union

    hits = lists.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), met(q).alias("ids")) for i, q in queries.items()])).alias("hit"))
    pairs = hits.select(F.col("hit.rule").alias("rule"), F.explode("hit.ids").alias("doc_id"))
    return pairs.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def spans_of(gaps: Column, whole: Column, part: Column, least: int, number: int) -> Column:
    """Spans of matches whose checked group is long enough: starts add up from the texts between and in matches."""
    lengths = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["part"]).alias("part")),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["whole"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.filter(lengths, lambda x: x["whole"].isNotNull()), begin, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: sorted spans (start, kind number in ``rules``, end), in code points, end exclusive.

    Matches of one kind are leftmost and do not overlap; a match that fails its length check is dropped but has
    been passed over. Null and empty texts have no spans. Rows with a null doc_id are outside the index and are
    scanned by every rule; rows of equal ids share their candidacy, each is verified on its own text. A column
    named found is replaced; other extra columns stay.
    """
    keep = [c for c in docs.columns if c != "found"]
    rows = docs.select(*keep)
    named = candidates(rows, rules)
    if named is None:
        rows = rows.withColumn("_rules", F.lit(None).cast("array<int>"))
    else:
        named = stored(named.withColumnRenamed("rules", "_rules"), "secret-candidates")
        few = named.count() <= BROADCAST_ROWS  # beyond, texts and candidates are sorted and merged
        rows = rows.join(F.broadcast(named) if few else named, "doc_id", "left")
    none = F.array().cast("array<string>")
    held = rows
    for i, rule in enumerate(rules):
        asked = F.lit(True) if trigram_query(rule.pattern) is None else F.col("doc_id").isNull() | F.coalesce(F.array_contains("_rules", i), F.lit(False))
        held = held.withColumn(f"_whole{i}", F.when(asked & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).otherwise(none))
    spans = []
    for i, rule in enumerate(rules):
        any_match = F.size(f"_whole{i}") > 0
        part = F.col(f"_whole{i}") if rule.group == 0 else F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
        spans.append(
            F.when(any_match, spans_of(F.split("text", rule.pattern, -1), F.col(f"_whole{i}"), part, rule.least, i))
            .otherwise(F.array().cast(SPANS))
        )
    return held.select(*keep, F.array_sort(F.concat(*spans)).alias("found"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``. Spans must be sorted."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base, RULES), 256).alias("base_sha256"), joined(F.col("found"), RULES).alias("spans"),
    )


def _found_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {number} AS k, '{kind}' AS kind, list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(m) for m in whole[1:i-1]]), 0) AS s, length(whole[i]) AS n
    FROM (SELECT doc_id, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}', 0) AS whole,
                 regexp_extract_all(text, '{quoted}', {group}) AS part FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(whole) + 1)) AS i)
    WHERE length(part[i]) >= {least}"""


#: Written on the contract's patterns, with all matches of the hexadecimal one and the length check after.
ORACLE = (
    "WITH f AS ("
    + " UNION ALL ".join(
        [
            _found_sql(0, "assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
            _found_sql(1, "access", "AKIA[A-Z0-9]+", 0, 18),
            _found_sql(2, "hex", "[0-9a-f]{16,}", 0, 16),
            _found_sql(3, "github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
            _found_sql(4, "slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
            _found_sql(5, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ]
    )
    + """), t AS (SELECT doc_id, k, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM f),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
             string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM t GROUP BY 1)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)"""
)
