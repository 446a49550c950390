"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, let, table, whole, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in that is was for it with as on be by at this are or an "
    "der die und das den von mit für ist zu ein eine auf sich nicht auch des im "
    "le la les et des du une un que pour est dans par sur au aux qui "
    "el los las y por con para una del al lo se su no"
).split()
# (ratio, numerator, denominator, smallest words, lowest, highest); NULL bounds do not bind, a zero denominator passes.
RULES = (
    ("word_length", "word_chars", "n_words", 1, 2.0, 12.0),
    ("symbols_per_word", "n_symbols", "n_words", 1, None, 0.2),
    ("stop_word_ratio", "n_stop", "n_words", 80, 0.01, None),
    ("dup_line_ratio", "n_dup_lines", "n_lines", 1, None, 0.4),
    ("ellipsis_line_ratio", "n_ellipsis", "n_lines", 1, None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def repeated_words(w: Column) -> Column:
    """Words of array ``w`` inside a 5-word window that the array holds twice or more.

    Window hashes find texts without any repeat cheaply; the others are decided on the words themselves.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))

    def hashes(h: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]))

    def covered(g: Column) -> Column:
        same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
        marked = F.transform(g, lambda x, j: F.struct(x["i"].alias("i"), (same(x, F.get(g, j + 1)) | ((j > 0) & same(x, F.get(g, j - 1)))).alias("r")))
        at = F.array_sort(F.transform(F.filter(marked, lambda m: m["r"]), lambda m: m["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def exact() -> Column:
        grams = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, WINDOW)).alias("g"), i.alias("i")))
        return let(F.array_sort(grams), covered)

    has_repeat = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(hashes(h), lambda g: F.size(F.array_distinct(g)) < F.size(g)))
    return F.when(n <= WINDOW, 0).otherwise(F.when(has_repeat, exact()).otherwise(0)).cast("long")


def profile(text: Column) -> Column:
    """Struct of counts of one text (NULL counts as empty), all in one expression."""

    def counts(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.size(F.filter(w, lambda x: ascii_lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
                repeated_words(w).alias("n_repeat_words"),
            )

        def of_lines(ls: Column) -> Column:
            return F.struct(
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(ls, lambda x: x.endswith("..."))).cast("long").alias("n_ellipsis"),
            )

        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
        return F.struct(let(words_of(t), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))

    return let(whole(text), counts)


def flatten(p: Column) -> dict[str, Column]:
    out = {c: p["w"][c] for c in ("n_words", "word_chars", "n_stop", "n_repeat_words")}
    out |= {c: p["l"][c] for c in ("n_lines", "n_dup_lines", "n_ellipsis")}
    return out | {"n_symbols": p["n_symbols"]}


def compile_rules(rules: Sequence[tuple], c: dict[str, Column]) -> Column:
    """True when a row passes every rule of the table."""
    ok = F.lit(True)
    for _, top, bottom, least, low, high in rules:
        ratio = F.try_divide(c[top], c[bottom])
        inside = F.lit(True)
        if low is not None:
            inside = inside & (ratio >= low)
        if high is not None:
            inside = inside & (ratio <= high)
        ok = ok & ((c["n_words"] < least) | (c[bottom] == 0) | inside)
    return ok


def verdicts(docs: DataFrame, rules: Sequence[tuple] = RULES, text: str = "text") -> DataFrame:
    """Add the struct ``_quality``-like column of counts, ``base_failed`` and ``kept`` to every row.

    NULL or empty text has no words and fails the base rule.  Repeated rows are judged one by one,
    an empty table stays empty, and other columns pass through untouched.  The new column is named
    by ``free_name(docs, "_quality")``.
    """
    name, tmp = free_name(docs, "_quality"), free_name(docs, "_profile")
    d = docs.withColumn(tmp, profile(F.col(text)))
    c = flatten(F.col(tmp))
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    kept = ~failed & compile_rules(rules, c)
    fields = [v.alias(k) for k, v in c.items()] + [failed.alias("base_failed"), kept.alias("kept")]
    return d.withColumn(name, F.struct(*fields)).drop(tmp)


def keep_good(docs: DataFrame, rules: Sequence[tuple] = RULES, text: str = "text") -> DataFrame:
    """Rows that the rules keep, with the columns of ``docs``."""
    name = free_name(docs, "_quality")
    return verdicts(docs, rules, text).where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[F.col("_quality")[c].alias(c) for c in OUT])


def _rule_sql() -> str:
    parts = []
    for _, top, bottom, least, low, high in RULES:
        ratio, inside = f"{top}::DOUBLE / nullif({bottom}, 0)", []
        if low is not None:
            inside.append(f"{ratio} >= {low}::DOUBLE")
        if high is not None:
            inside.append(f"{ratio} <= {high}::DOUBLE")
        parts.append(f"(n_words < {least} OR {bottom} = 0 OR ({' AND '.join(inside)}))")
    return " AND ".join(parts)


WORDS_SQL = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
PROFILE_SQL = rf"""
q_doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {{docs}}),
q_tok AS (SELECT *, {WORDS_SQL.format(t='t')} AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM q_doc),
q_win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM q_tok WHERE len(w) >= 5)),
q_rep AS (SELECT rid, i FROM q_win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
q_cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM q_rep) GROUP BY rid),
q_cnt AS (SELECT q_tok.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(q_cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({STOP_SQL})))::BIGINT AS n_stop,
  len(list_filter(ls, lambda x: x LIKE '%...'))::BIGINT AS n_ellipsis
  FROM q_tok LEFT JOIN q_cov USING (rid)),
q_out AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q_cnt),
q_fin AS (SELECT *, NOT base_failed AND {_rule_sql()} AS kept FROM q_out)"""
SQL = f"WITH {PROFILE_SQL.format(docs='documents')}\nSELECT doc_id, {', '.join(OUT)} FROM q_fin"
