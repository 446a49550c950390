"""Secret scans: Boolean trigram queries over a trigram index, then verification by the rules' patterns.

The index holds postings (trigram, document) for the trigrams that some rule asks for.  A rule's pattern
is turned into clauses, each a set of trigrams that a matching text must hold; a document is a candidate
when it holds all trigrams of one clause.  Candidates are verified with the pattern; rules without a
mandatory trigram scan every text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, row_key, stored, table, up_to, whole

BROADCAST_KEYS = 200_000
MAX_CLAUSES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1  # code points of ``group``


# The three base rules first, in their stated order, then the added ones.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE_RULES = (
    Rule("assign", ASSIGN, 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"Authorization: Bearer [A-Za-z0-9._~+/-]{16,}"),
)
RULES = BASE_RULES + ADDED_RULES


def _fold(chars: set[str]) -> str | None:
    low = {c.lower() for c in chars}
    return low.pop() if len(low) == 1 and all(c.isascii() for c in chars) else None


def literal_runs(pattern: str) -> list[list[str]]:
    """Alternatives of a pattern, each a list of lower-case literal runs that a match must contain.

    Works on the standard library's parse of the pattern.  Anything that is not a literal, a class of
    one letter in both cases, a group or an alternation ends the current run.
    """

    def walk(items) -> list[list[str]]:
        paths: list[list[str]] = [[""]]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and chr(arg).isascii():
                options = [[chr(arg).lower()]]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and (one := _fold({chr(c) for _, c in arg})):
                options = [[one]]
            elif name == "SUBPATTERN":
                options = walk(arg[-1])
            elif name == "BRANCH":
                options = [p for branch in arg[1] for p in walk(branch)]
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                options = [["", *p, ""] for p in walk(arg[2])]
            else:
                options = [["", ""]]
            joined = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in itertools.product(paths, options)]
            # too many alternatives: what stands so far stays mandatory, the rest is left out
            paths = joined if len(joined) <= MAX_CLAUSES else [[*a, ""] for a in paths]
        return paths

    return [[r for r in p if r] for p in walk(re._parser.parse(pattern))]


def trigram_clauses(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of trigrams; empty when some alternative has no mandatory trigram (full scan)."""
    clauses = [frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)) for runs in literal_runs(pattern)]
    if not all(clauses):
        return []
    return [c for c in dict.fromkeys(clauses) if not any(o < c for o in clauses)]


def clause_rows(rules: Sequence[Rule]) -> list[tuple[str, int, str, int]]:
    """(rule kind, clause number, trigram, trigrams of the clause) of every indexed rule."""
    return [(r.kind, k, t, len(c)) for r in rules for k, c in enumerate(trigram_clauses(r.pattern)) for t in sorted(c)]


def build_index(docs: DataFrame, trigrams: Sequence[str], key: str = "_key", text: str = "_text") -> DataFrame:
    """Postings (trigram, key) of the given trigrams, found in the lower-cased texts."""
    low = F.lower(F.col(text))
    held = let(low, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in trigrams])))
    return docs.select(F.explode(held).alias("trigram"), key).select("trigram", key)


def intersect(postings: DataFrame, rules: Sequence[Rule], key: str = "_key") -> DataFrame:
    """Candidates (key, kinds): documents in all postings of some clause of a rule."""
    spark = postings.sparkSession
    clauses = spark.createDataFrame(clause_rows(rules), "kind string, clause int, trigram string, need int")
    hits = postings.join(F.broadcast(clauses), "trigram")  # one row per trigram of the rule list
    full = hits.groupBy(key, "kind", "clause", "need").agg(F.count_distinct("trigram").alias("have")).where("have = need")
    return full.groupBy(key).agg(F.collect_set("kind").alias("_kinds"))


def match_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of a rule as structs (start, rank, end, kind), in code points."""
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")

    def build(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(a: Column, i: Column) -> Column:
            begin = a["at"] + F.length(F.get(parts["gap"], i))
            end = begin + F.length(F.get(parts["hit"], i))
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            ok = F.length(F.get(parts["val"], i)) >= rule.least
            return F.struct(end.alias("at"), F.when(ok, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        n = F.size(parts["hit"])
        return F.when(n == 0, empty).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step, lambda a: a["out"]))

    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("val"),
    )
    return F.when(text.rlike(rule.pattern), let(parts, build)).otherwise(empty)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``found``: array of spans (start, rank, end, kind) ordered by start, then rule order.

    NULL text counts as empty.  NULL ids, repeated ids and repeated rows each give their own row, since
    candidates are keyed by id and text digest and every candidate is verified on its own text.  Other
    columns are ignored.  Very long texts are scanned whole.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("_text"), row_key(doc_id, text).alias("_key"))
    indexed = [r for r in rules if trigram_clauses(r.pattern)]
    wanted = sorted({t for _, _, t, _ in clause_rows(indexed)})
    if wanted:
        candidates = stored(intersect(build_index(d, wanted), indexed), "secret-candidates")
        if up_to(candidates, BROADCAST_KEYS):
            candidates = F.broadcast(candidates)
        d = d.join(candidates, "_key", "left")
    else:
        d = d.withColumn("_kinds", F.expr("cast(null as array<string>)"))
    spans = []
    for rank, rule in enumerate(rules):
        hits = match_spans(F.col("_text"), rule, rank)
        if rule in indexed:
            none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
            hits = F.when(F.array_contains("_kinds", rule.kind), hits).otherwise(none)
        spans.append(hits)
    return d.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))

    def count(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def _sql() -> str:
    q = lambda p: p.replace("'", "''")
    lists, spans = [], []
    for k, r in enumerate(RULES):
        lists.append(f"string_split_regex(t, '{q(r.pattern)}') AS g{k}, regexp_extract_all(t, '{q(r.pattern)}') AS h{k}, regexp_extract_all(t, '{q(r.pattern)}', {r.group}) AS v{k}")
        size = lambda x, upto: f"coalesce(list_sum(list_transform({x}[1:{upto}], lambda y: length(y))), 0)"
        begin = f"({size(f'g{k}', 'i')} + {size(f'h{k}', 'i - 1')})::BIGINT"
        spans.append(
            f"list_transform(list_filter(range(1, len(h{k}) + 1), lambda i: length(v{k}[i]) >= {r.least}), "
            f"lambda i: {{'s': {begin}, 'r': {k}, 'e': ({begin} + length(h{k}[i]))::BIGINT, 'k': '{r.kind}'}})"
        )
    base = len(BASE_RULES)
    text = lambda x: f"array_to_string(list_transform({x}, lambda s: s.k || ':' || s.s || ':' || s.e), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, {", ".join(lists)} FROM d),
f AS (SELECT doc_id, list_sort(flatten([{", ".join(spans)}])) AS found FROM p)
SELECT doc_id, {", ".join(f"len(list_filter(found, lambda s: s.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE_RULES)},
  sha256({text(f"list_filter(found, lambda s: s.r < {base})")}) AS base_sha256, {text("found")} AS spans FROM f"""


SQL = _sql()
