"""Mixing sources to target weights over fixed-length blocks of words.

Each source's texts form one word stream, cut into blocks of ``block`` words.  A source takes whole epochs
of its blocks and, in its last epoch, the first slots of a keyed pseudorandom permutation of the blocks;
the last slot is cut to the words that are still missing.  All slots are dealt to output shards by another
keyed permutation, so that the source counts of the shards are a multinomial draw conditioned on the
exact totals.  Slots and texts meet in a join on (source, block index).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, free_name, stored, table, whole

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 1024
SHARD_SLOTS = 4096
ROUNDS = 12
CHUNK = 4096
BUCKET_ROWS = 20_000


def sizes(text: Column) -> Column:
    return F.size(F.filter(F.split(whole(text), WS + "+", -1), lambda w: w != "")).cast("long")


def source_key(source: Column) -> Column:
    """Non-NULL join key of a source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size): shares by weight, none above ``cap`` times its size.

    Sources that reach their cap are those with the smallest size per weight, so one ordered pass finds the
    common share of the others.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = per_source.withColumn("weight", w.cast("long")).withColumn("_cap", F.col("source_size") * cap)
    order = W.orderBy((F.col("_cap") / F.col("weight")), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    d = d.withColumn("_pos", F.row_number().over(order)).withColumn("_share", left / open_weight)
    free = F.when(F.col("_cap") / F.col("weight") >= F.col("_share"), F.struct("_pos", "_share"))
    d = d.withColumn("_first", F.min(free).over(every))
    capped = F.col("_first").isNull() | (F.col("_pos") < F.col("_first._pos"))
    target = F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("_first._share") * F.col("weight"))
    return d.select("source", "source_size", "weight", target.alias("target"))


def number(text: Column, below: Column) -> Column:
    """Keyed number in [0, below)."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), below)


def permuted(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not permutation of [0, n): every round maps x to k - x mod n for a keyed half of the pairs."""

    def one(r: int):
        def turn(v: Column) -> Column:
            k = number(F.concat_ws("|", seed, F.lit(f"k{r}")), n)
            other = F.pmod(k - v, n)
            coin = F.substring(F.md5(F.concat_ws("|", seed, F.lit(f"b{r}"), F.greatest(v, other).cast("string"))), 1, 1) < "8"
            return F.when(coin, other).otherwise(v)

        return turn

    out = F.array(x)
    for r in range(rounds):
        out = F.transform(out, one(r))
    return out[0]


def sources_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source with target, whole epochs, words of the last epoch and slot counts."""
    t = source_targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")))
    words, s = F.floor("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    d = t.withColumn("skey", source_key(F.col("source")))
    d = d.withColumn("n_full", F.expr(f"source_size div {block}")).withColumn("tail", F.col("source_size") % block)
    d = d.withColumn("n_blocks", F.col("n_full") + (F.col("tail") > 0).cast("long"))
    d = d.withColumn("epochs", F.floor(words / s).cast("long")).withColumn("rest", F.pmod(words, s))
    d = d.withColumn("slots", F.col("epochs") * F.col("n_blocks") + F.ceil(F.col("rest") / block).cast("long"))
    every = W.orderBy(F.col("source").asc_nulls_last())
    d = d.withColumn("first_slot", F.sum("slots").over(every) - F.col("slots"))
    return d.withColumn("all_slots", F.sum("slots").over(W.partitionBy()))


def slot_plan(sources: DataFrame, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """One row per slot: skey, epoch, block, take (words from the block's start), shard, place in the shard."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long")))
    c = sources.where("slots > 0").withColumn("_c", starts).repartition("skey", "_c")  # spreads a large source
    s = c.withColumn("k", F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + CHUNK, F.col("slots")) - 1)))
    s = s.withColumn("epoch", F.expr("k div n_blocks")).withColumn("j", F.col("k") % F.col("n_blocks"))
    key = F.concat_ws("|", F.lit(seed), "skey", F.col("epoch").cast("string"))
    # the short tail block closes an epoch; full blocks are permuted
    s = s.withColumn("block", F.when(F.col("j") < F.col("n_full"), permuted(F.col("j"), F.col("n_full"), key)).otherwise(F.col("n_full")))
    length = F.when(F.col("block") < F.col("n_full"), F.lit(block)).otherwise(F.col("tail"))
    take = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - F.col("j") * block))
    place = permuted(F.col("first_slot") + F.col("k"), F.col("all_slots"), F.lit(f"{seed}|out"))
    s = s.select("skey", "epoch", "block", take.alias("take"), place.alias("place"))
    return s.withColumn("shard", F.expr(f"place div {SHARD_SLOTS}")).withColumn("slot", F.col("place") % SHARD_SLOTS).drop("place")


def hex_digits(n_rows: int) -> int:
    """Leading digest digits that cut ``n_rows`` into buckets of at most about ``BUCKET_ROWS``."""
    digits = 1
    while 16**digits * BUCKET_ROWS < n_rows:
        digits += 1
    return digits


def placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """Add ``off``, the first word's place in the source's stream, ordered by id digest, id and text digest.

    Two levels: running sums inside (source, digest prefix) buckets, then over the bucket totals, so that no
    source is ordered in one task.
    """
    d = rows.withColumn("_b", F.substring("_h", 1, hex_digits(n_rows)))
    inner = W.partitionBy("skey", "_b").orderBy("_h", "_ord", "_t")
    d = d.withColumn("_rn", F.row_number().over(inner)).withColumn("_in", F.sum("_size").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"))
    totals = rows.groupBy("skey", F.substring("_h", 1, hex_digits(n_rows)).alias("_b")).agg(F.sum("_size").alias("_n"))
    totals = totals.withColumn("_before", F.sum("_n").over(W.partitionBy("skey").orderBy("_b")) - F.col("_n")).drop("_n")
    return d.join(totals, ["skey", "_b"]).withColumn("off", F.col("_before") + F.col("_in"))


def prepared(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), source_key(F.col(source)).alias("skey"), sizes(F.col(text)).alias("_size"),
        F.md5(ident).alias("_h"), F.col(doc_id).alias("_ord"), F.coalesce(F.md5(F.col(text)), F.lit("")).alias("_t"),
    )


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Explode rows with ``off`` and ``_size`` into their block pieces [lo, hi) (offsets inside the block)."""
    last = F.expr(f"(off + _size - 1) div {block}")
    span = F.when(F.col("_size") > 0, F.sequence(F.expr(f"off div {block}"), last))
    d = rows.withColumn("block", F.explode_outer(span))
    at = F.col("block") * block
    return d.withColumn("lo", F.greatest(F.col("off") - at, F.lit(0))).withColumn("hi", F.least(F.col("off") + F.col("_size") - at, F.lit(block)))


def mix_amounts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_shard`` for every row.

    Sizes are word counts (NULL text: 0, such rows take nothing).  NULL is a source of its own, last in
    order.  NULL and repeated ids and repeated rows keep a row each; of equal rows it is open which takes
    which share, their multiset is fixed.  An empty table gives no row.  Other columns are ignored.
    """
    rows = stored(prepared(docs, doc_id, text, source), "mix-rows")  # the texts are read once
    sources = stored(sources_of(rows, block), "mix-sources")
    slots = slot_plan(sources, block=block)
    whole_uses = F.when(F.col("take") == F.col("_len"), 1).otherwise(0)
    uses = slots.join(sources.select("skey", "n_full", "tail"), "skey").withColumn("_len", F.when(F.col("block") < F.col("n_full"), F.lit(block)).otherwise(F.col("tail")))
    uses = uses.groupBy("skey", "block").agg(
        F.sum(whole_uses).alias("_uses"), F.max(F.when(F.col("take") < F.col("_len"), F.col("take"))).alias("_cut"), F.min("shard").alias("_shard")
    )
    n_rows = rows.count()
    p = pieces(placed(rows, n_rows).select("doc_id", "source", "skey", "_b", "_rn", "_size", "off"), block)
    j = p.join(uses, ["skey", "block"], "left")
    cut = F.greatest(F.least("hi", F.coalesce("_cut", F.lit(0))) - F.col("lo"), F.lit(0))
    got = F.coalesce("_uses", F.lit(0)) * (F.col("hi") - F.col("lo")) + cut
    out = j.groupBy("doc_id", "source", "skey", "_b", "_rn", "_size").agg(F.coalesce(F.sum(got), F.lit(0)).alias("taken"), F.min("_shard").alias("first_shard"))
    out = out.join(sources.select("skey", "source_size", "target"), "skey")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "first_shard")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix as documents: one row per row of ``docs`` and epoch that takes words of it, with the columns of ``docs``.

    A text taken whole stays as it is; of others the taken words remain, joined by blanks.  Edge cases as
    in ``mix_amounts``; rows without words are not part of a mix.
    """
    rows = stored(prepared(docs, doc_id, text, source), "mix-rows")
    sources = stored(sources_of(rows, block), "mix-sources")
    n_rows = rows.count()
    slots = slot_plan(sources, block=block).select("skey", "epoch", "block", "take")
    p = pieces(placed(rows, n_rows).where("_size > 0").select("skey", "_size", "off"), block)
    got = p.join(slots, ["skey", "block"]).withColumn("hi", F.least("hi", "take")).where("hi > lo")
    begin = F.col("block") * block - F.col("off")
    spans = got.groupBy("skey", "off", "epoch").agg(
        F.sort_array(F.collect_list(F.struct((begin + F.col("lo")).alias("a"), (begin + F.col("hi")).alias("b")))).alias("_spans"),  # blocks of one text
        F.sum(F.col("hi") - F.col("lo")).alias("_got"),
    )
    names = {c: free_name(docs, c) for c in ("skey", "_size", "_h", "_ord", "_t", "_row")}
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    full = packed.select(
        "_row", source_key(F.col("_row")[source]).alias("skey"), sizes(F.col("_row")[text]).alias("_size"),
        F.md5(F.coalesce(F.col("_row")[doc_id].cast("string"), F.lit(""))).alias("_h"), F.col("_row")[doc_id].alias("_ord"),
        F.coalesce(F.md5(F.col("_row")[text]), F.lit("")).alias("_t"),
    )
    j = placed(full, n_rows).where("_size > 0").join(spans, ["skey", "off"])
    words = F.filter(F.split(F.col("_row")[text], WS + "+", -1), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(words, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))), " ")
    new_text = F.when(F.col("_got") == F.col("_size"), F.col("_row")[text]).otherwise(cut)
    return j.select(*[new_text.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_amounts(table(spark, sf_dir, "documents"))


def _permuted_sql(x: str, n: str, seed: str) -> list[tuple[str, str]]:
    """(column, expression) steps of the swap-or-not permutation, one per round."""
    steps, v = [], x
    for r in range(ROUNDS):
        k = f"('0x' || substr(md5({seed} || '|k{r}'), 1, 15))::BIGINT % {n}"
        o = f"((({k}) - {v}) % {n} + {n}) % {n}"
        steps.append((f"o{r}", o))
        steps.append((f"v{r}", f"CASE WHEN substr(md5({seed} || '|b{r}|' || greatest({v}, o{r})), 1, 1) < '8' THEN o{r} ELSE {v} END"))
        v = f"v{r}"
    return steps


def _chain(name: str, base: str, steps: list[tuple[str, str]]) -> str:
    parts, prev = [], base
    for i in range(0, len(steps), 2):
        (a, ea), (b, eb) = steps[i], steps[i + 1]
        parts.append(f"{name}{i} AS (SELECT *, {eb} AS {b} FROM (SELECT *, {ea} AS {a} FROM {prev}))")
        prev = f"{name}{i}"
    return ",\n".join(parts)


_LAST = f"v{ROUNDS - 1}"
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '')) AS h, coalesce(md5(text), '') AS t FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * {CAP} AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos,
  ((sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE /
   (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) AS share
  FROM s1 WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST)),
s3 AS (SELECT *, min(CASE WHEN cap::DOUBLE / weight::DOUBLE >= share THEN pos END) OVER () AS first_pos FROM s2),
s4 AS (SELECT *, CASE WHEN first_pos IS NULL OR pos < first_pos THEN cap::DOUBLE ELSE max(CASE WHEN pos = first_pos THEN share END) OVER () * weight END AS target FROM s3),
s5 AS (SELECT *, source_size // {BLOCK} AS n_full, source_size % {BLOCK} AS tail, floor(target)::BIGINT // greatest(source_size, 1) AS epochs,
  floor(target)::BIGINT % greatest(source_size, 1) AS rest, coalesce('s' || source, 'n') AS skey FROM s4),
s6 AS (SELECT *, n_full + (tail > 0)::BIGINT AS n_blocks FROM s5),
s7 AS (SELECT *, epochs * n_blocks + (rest + {BLOCK} - 1) // {BLOCK} AS slots FROM s6),
s8 AS (SELECT *, (sum(slots) OVER (ORDER BY source NULLS LAST) - slots)::BIGINT AS first_slot, (sum(slots) OVER ())::BIGINT AS all_slots FROM s7),
k0 AS (SELECT *, k // n_blocks AS epoch, k % n_blocks AS j FROM (SELECT *, unnest(range(0, slots)) AS k FROM s8 WHERE slots > 0)),
k1 AS (SELECT *, 'mix|' || skey || '|' || epoch AS seed, first_slot + k AS g FROM k0),
{_chain('a', 'k1', _permuted_sql('j', 'greatest(n_full, 1)', 'seed'))},
k2 AS (SELECT skey, n_full, tail, epochs, epoch, rest, j, g, all_slots, CASE WHEN j < n_full THEN {_LAST} ELSE n_full END AS block FROM a{2 * ROUNDS - 2}),
{_chain('b', 'k2', _permuted_sql('g', 'all_slots', "'mix|out'"))},
k3 AS (SELECT *, {_LAST} // {SHARD_SLOTS} AS shard, CASE WHEN block < n_full THEN {BLOCK} ELSE tail END AS len FROM b{2 * ROUNDS - 2}),
k4 AS (SELECT *, CASE WHEN epoch < epochs THEN len ELSE least(len, rest - j * {BLOCK}) END AS take FROM k3),
o AS (SELECT *, coalesce('s' || source, 'n') AS skey, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, t, rid) - size)::BIGINT AS off FROM d),
p AS (SELECT rid, skey, off, size, unnest(range(off // {BLOCK}, (off + size - 1) // {BLOCK} + 1)) AS block FROM o WHERE size > 0),
g AS (SELECT rid, sum(greatest(least(off + size - p.block * {BLOCK}, take) - greatest(off - p.block * {BLOCK}, 0), 0))::BIGINT AS taken, min(shard) AS first_shard
  FROM p JOIN k4 USING (skey, block) GROUP BY rid)
SELECT o.doc_id, o.size, s8.source_size, s8.target, coalesce(g.taken, 0) AS taken, g.first_shard
FROM o JOIN s8 USING (skey) LEFT JOIN g USING (rid)"""
