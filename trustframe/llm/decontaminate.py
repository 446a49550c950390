"""Benchmark decontamination: a hash set of the benchmark's word windows against all windows of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, row_key, scratch, stored, table
from .hashing import WordHash, rolling, small_batches, word_hashes
from .shared import forget

WINDOW = 10
# Windows per broadcast block; a larger benchmark is looked up block by block.
BLOCK_WINDOWS = 500_000
PART_BYTES = 2_000_000
TABLE_BITS = 22
# Bytes that separate words become blanks, A-Z become a-z, all else stays.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(BYTES).split() if text else []


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item): every 10 consecutive words of an item, or its whole text when shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, raw in zip(batch["item"], batch["raw"]):
                w = words_of(raw)
                n = min(len(w), WINDOW)
                rows += [(b" ".join(w[i : i + n]), n, item) for i in range(len(w) - n + 1 if n else 0)]
            yield pd.DataFrame(rows, columns=["window", "n", "item"])

    d = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("raw"))
    return d.mapInPandas(cut, "window binary, n int, item string").distinct()


def window_set(rows) -> tuple[np.ndarray, np.ndarray, dict[bytes, list[str]], list[int]]:
    """(flag table, sorted hashes, window -> items, lengths) of collected (window, n, item) rows."""
    items: dict[bytes, list[str]] = {}
    hashes, lengths, cache = [], set(), WordHash()
    for r in rows:
        key = bytes(r["window"])
        items.setdefault(key, [])
        if r["item"] is not None:
            items[key].append(r["item"])
        lengths.add(r["n"])
    for key in items:
        w = key.split()
        hashes.append(rolling(word_hashes(w, cache), [len(w)])[len(w)][0])
    h = np.unique(np.array(hashes, np.uint64))
    flags = np.zeros(1 << TABLE_BITS, bool)
    flags[h >> np.uint64(64 - TABLE_BITS)] = True
    return flags, h, items, sorted(lengths)


def _find(docs: DataFrame, known) -> DataFrame:
    """Per row of (doc_id, key, raw): word count, hit word ranges and item ids found."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        flags, hashes, items, lengths = known.value
        cache = WordHash()
        for batch in batches:
            for part in small_batches(batch, "raw", PART_BYTES):
                lists = [words_of(t) for t in part["raw"]]
                counts = np.array([len(w) for w in lists])
                ends = np.cumsum(counts)
                words = [w for ws in lists for w in ws]
                ranges: list[list[tuple[int, int]]] = [[] for _ in lists]
                found: list[set[str]] = [set() for _ in lists]
                for n, g in (rolling(word_hashes(words, cache), lengths) if words and lengths else {}).items():
                    at = np.nonzero(flags[g >> np.uint64(64 - TABLE_BITS)])[0]
                    at = at[np.isin(g[at], hashes)]
                    doc = np.searchsorted(ends, at, "right")
                    for i, d in zip(at[at + n <= ends[doc]].tolist(), doc[at + n <= ends[doc]].tolist()):
                        known_items = items.get(b" ".join(words[i : i + n]))  # verified on the words
                        if known_items is not None:
                            lo = i - int(ends[d] - counts[d])
                            ranges[d].append((lo, lo + n))
                            found[d].update(known_items)
                out = part[["doc_id", "key"]].copy()
                out["n_words"] = counts
                out["hits"] = [[{"lo": a, "hi": b} for a, b in merged(r)] for r in ranges]
                out["items"] = [sorted(f) for f in found]
                yield out

    ident = docs.schema["doc_id"].dataType.simpleString()
    # ids pass through pandas as text: a long column with a NULL would become double there
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(scan, "doc_id string, key string, n_words long, hits array<struct<lo:int,hi:int>>, items array<string>")
    return out.withColumn("doc_id", F.col("doc_id").cast(ident))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(hits: Column) -> Column:
    """Words inside the union of ranges sorted by ``lo``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, r: F.struct(
        (a["n"] + F.greatest(r["hi"] - F.greatest(r["lo"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], r["hi"]).alias("end")
    )
    return F.aggregate(F.array_sort(hits), start, step, lambda a: a["n"]).cast("long")


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, key, n_words, hits, items`` for every row; ``hits`` are word ranges [lo, hi).

    NULL and empty texts have no words and no hits.  Repeated rows, NULL and repeated ids keep a row each.
    Items without words are ignored; items with a NULL id mark words but are not listed; repeated items
    count once.  Empty tables give no hits or no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items), "bench-windows")
    blocks = max(1, -(-windows.count() // block_windows))
    d = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("raw"))
    # a block is cut by hash, so it may exceed its share a little; windows of one hash stay together
    of = F.pmod(F.xxhash64("window"), F.lit(blocks))
    block = lambda b: spark.sparkContext.broadcast(window_set(windows.where(of == b).collect()))
    if blocks == 1:
        return _find(d, block(0))
    path = scratch(spark, "bench-hits")
    for b in range(blocks):  # one block's set at a time: collected, sent, used and given back
        sent = block(b)
        out = _find(d, sent).drop("doc_id", "n_words")
        out.where(F.size("hits") > 0).write.mode("append").parquet(path)
        sent.destroy()
    got = spark.read.schema(out.schema).parquet(path).groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    # collected lists hold one row per block and copy of a text
    empty = _find(d, spark.sparkContext.broadcast(window_set([]))).select("doc_id", "key", "n_words")
    j = empty.join(got, "key", "left")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c)
    return j.select("doc_id", "key", "n_words", none("hits", "array<struct<lo:int,hi:int>>"), none("items", "array<string>"))


def remove_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without any hit, columns unchanged; NULL and empty texts, NULL ids and repeated rows stay."""
    bad = find(docs, items, doc_id, text).where(F.size("hits") > 0).select("key").distinct()
    name = free_name(docs, "_key")
    k = docs.withColumn(name, row_key(doc_id, text))
    return k.join(bad.select(F.col("key").alias(name)), name, "left_anti").drop(name)


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` with every hit word run cut out of the text; rows that lose all words go.

    Rows without a hit stay as they are, NULL and empty texts and repeated rows included.  Extra columns may
    have any name.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "cut": [_without(t, h) for t, h in zip(batch["raw"], batch["hits"])]})

    hits = find(docs, items, doc_id, text).where(F.size("hits") > 0).select("key", "hits").dropDuplicates(["key"])
    name, cut_name = free_name(docs, "_cut_key"), free_name(docs, "_cut_text")
    k = docs.withColumn(name, row_key(doc_id, text))
    raw = k.select(F.col(name).alias("key"), F.col(text).cast("binary").alias("raw")).join(hits, "key").dropDuplicates(["key"])
    new = raw.mapInPandas(cut, "key string, cut string").toDF(name, cut_name)
    j = k.join(new, name, "left")
    left = F.when(F.col(cut_name).isNull(), F.col(f"`{text}`")).otherwise(F.col(cut_name))
    kept = j.where(F.col(cut_name).isNull() | (F.trim(cut_name) != ""))
    return kept.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _without(text: bytes, hits) -> str:
    """The text without the bytes from the first to the last word of each hit range."""
    flat, at, spans = text.translate(BYTES), 0, []
    for w in flat.split():
        at = flat.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for h in hits:
        out.append(text[last : spans[h["lo"]][0]])
        last = spans[h["hi"] - 1][1]
    return (b"".join(out) + text[last:]).decode("utf-8", "replace")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = covered(F.col("hits"))
    return f.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def windows_sql(docs: str) -> str:
    """CTEs ending in ``c_out``: the contract's columns plus ``rid`` for the rows of ``docs``."""
    words = (
        r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    )
    return f"""
c_doc AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {docs}),
c_itm AS (SELECT item_id, {words} AS w FROM benchmark),
c_win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM
  (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM c_itm WHERE len(w) > 0)),
c_len AS (SELECT DISTINCT n FROM c_win),
c_pos AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM
  (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM c_doc, c_len WHERE len(w) >= n)),
c_hit AS (SELECT rid, item_id, i, n FROM c_pos JOIN c_win USING (n, g)),
c_cov AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM c_hit) GROUP BY rid),
c_ids AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM
  (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM c_hit WHERE item_id IS NOT NULL) GROUP BY rid),
c_out AS (SELECT c_doc.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM c_doc LEFT JOIN c_cov USING (rid) LEFT JOIN c_ids USING (rid))"""


SQL = f"WITH {windows_sql('documents')}\nSELECT * EXCLUDE (rid) FROM c_out"
