"""MinHash near-dedup with odd sketches.

Texts with equal shingle sets form a class.  Classes meet in MinHash bands; each band bucket links its
members to one random member (a star, not all pairs).  Parity bitmaps of the MinHash samples estimate the
similarity of a pair; likely pairs are confirmed on the full shingle sets.  Where a bucket still holds
several components, the pairs between them that can reach the limit are tested too, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, row_key, stored, table, up_to
from .hashing import WordHash, mixed, rolling, small_batches, word_hashes
from .shared import forget

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4  # a pair at similarity 0.75 misses all bands with probability (1 - 0.75**4)**40, about 2e-7
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
# Estimates below this are not verified: of pairs at similarity 0.75, 1.3e-8 (exact parity distribution), fewer than the bands miss.
FLOOR = 0.35
PART_BYTES = 1_000_000
BROADCAST_ROWS = 200_000
STAR_ROUNDS = 2
# Nodes and shingles per block of a region (about, blocks are cut by hash) and shingles counted at once in a tile.
TILE_ROWS, TILE_SHINGLES, TILE_COLUMNS = 256, 500_000, 4096
# Members of a band bucket that one task compares the others with.
BUCKET_BLOCK = 2048


def seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    xor = r.integers(0, 2**63, SAMPLES, dtype=np.uint64)
    return xor, r.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes | None], cache: WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes per text (empty without words)."""
    lists = [t.lower().split() if t else [] for t in texts]
    counts = [len(w) for w in lists]
    words = [w for ws in lists for w in ws]
    if not words:
        return [np.empty(0, np.uint64) for _ in lists]
    grams = rolling(word_hashes(words, cache), range(1, SHINGLE + 1))
    out, at = [], 0
    for n in counts:
        size = min(n, SHINGLE)
        out.append(np.unique(grams[size][at : at + n - size + 1]) if n else np.empty(0, np.uint64))
        at += n
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(samples, sets) minima; the sets must not be empty."""
    xor, odd = seeds()
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((SAMPLES, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SAMPLES):
            out[i] = np.minimum.reduceat((flat ^ xor[i]) * odd[i], starts)
    return out


def band_hashes(mins: np.ndarray) -> np.ndarray:
    """(sets, bands) signed 64-bit bucket numbers."""
    with np.errstate(over="ignore"):
        m = mins.reshape(BANDS, ROWS, -1)
        g = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) * np.ones(mins.shape[1], np.uint64)
        for r in range(ROWS):
            g = mixed(g ^ m[:, r])
    return g.T.astype(np.int64, copy=False)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(sets, words) 64-bit words of the parity bitmap over (sample number, minimum)."""
    n = mins.shape[1]
    with np.errstate(over="ignore"):
        salt = np.arange(1, SAMPLES + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
        bit = (mixed(mins ^ salt) >> np.uint64(56)).astype(np.int64)
    bits = np.zeros((n, SKETCH_BITS), np.uint8)
    rows = np.arange(n)
    for i in range(SAMPLES):
        bits[rows, bit[i]] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the XOR population count of two odd sketches (negative when far apart)."""
    ones = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    inside = F.greatest(1 - 2 * ones / SKETCH_BITS, F.lit(1e-6))
    return 1 + F.log(inside) * (SKETCH_BITS / (4 * SAMPLES))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, th, raw) -> doc_id, th, n, cls (set digest), bands, sketch; NULL cls without words.

    Ids pass through pandas as text: a long column with a NULL would become double there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        cache = WordHash()
        for batch in batches:
            for part in small_batches(batch, "raw", PART_BYTES):
                sets = shingle_sets(list(part["raw"]), cache)
                full = [k for k, s in enumerate(sets) if len(s)]
                out = part[["doc_id", "th"]].copy()
                out["n"] = [len(s) for s in sets]
                cls, bands, sketch = ([None] * len(sets) for _ in range(3))
                if full:
                    mins = minhashes([sets[k] for k in full])
                    for k, b, o in zip(full, band_hashes(mins), odd_sketches(mins)):
                        cls[k], bands[k], sketch[k] = xxhash.xxh3_128_hexdigest(sets[k].tobytes()), b, o
                out["cls"], out["bands"], out["sketch"] = cls, bands, sketch
                yield out

    ident = docs.schema["doc_id"].dataType.simpleString()
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, th long, n long, cls string, bands array<long>, sketch array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast(ident))


def full_sets(texts: DataFrame) -> DataFrame:
    """(raw) -> cls, members: the shingle set of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        cache = WordHash()
        for batch in batches:
            for part in small_batches(batch, "raw", PART_BYTES):
                sets = shingle_sets(list(part["raw"]), cache)
                yield pd.DataFrame({"cls": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "members": [s.view(np.int64) for s in sets]})

    return texts.mapInPandas(run, "cls string, members array<long>")


def small_or_not(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if up_to(df, BROADCAST_ROWS) else df


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, members): the full shingle sets of the distinct ``nodes``, from one text of each class."""
    who = stored(classes.select("node", "cls", "th").join(nodes, "node", "left_semi"), "near-nodes")
    texts = docs.select("th", "raw").join(small_or_not(who.select("th").distinct()), "th", "left_semi")
    texts = texts.groupBy(F.md5("raw").alias("d")).agg(F.first("raw").alias("raw")).select("raw")  # copies collapse in the map tasks
    sets = full_sets(texts).dropDuplicates(["cls"]).join(who.select("node", "cls"), "cls")
    return stored(sets.select("node", "members"), "near-sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the similarity."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    common = F.size(F.array_intersect("ma", "mb"))
    return two.where(100 * common >= PERCENT * (F.size("ma") + F.size("mb") - common)).select("a", "b")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def to_roots(up: DataFrame) -> DataFrame:
    """(node, up) with every pointer moved to the end of its chain, which halves in each step."""
    while True:
        ahead = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        step = stored(up.join(ahead, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "near-parents")
        up = step.select("node", "up")
        if step.where("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes on edges (a, b): hook to the smallest neighbour, follow to the root, contract, repeat."""
    label, e = None, stored(edges.where("a <> b").distinct(), "near-edges")
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "near-parents")
        up = to_roots(up)
        if label is None:
            label = up.withColumnRenamed("up", "comp")
        else:
            step = up.withColumnRenamed("node", "comp")
            label = label.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        ends = e.join(up.select(F.col("node").alias("a"), F.col("up").alias("pa")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("pb")), "b")
        e = stored(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "near-edges")
    empty = edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    return stored(label if label is not None else empty, "near-comps")


def with_comp(df: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    c = comps.select(F.col("node").alias(node), F.col("comp").alias("_c"))
    return df.join(c, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components, with the components as ca and cb."""
    return with_comp(with_comp(pairs, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb")


def grown(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between them."""
    more = components(apart(links, comps).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    kept = comps.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left")
    moved = kept.select("node", F.coalesce("up", "comp").alias("comp"))
    fresh = more.join(comps, "node", "left_anti").select("node", "comp")
    return stored(moved.union(fresh), "near-comps")


def link_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, comp) for all classes that have a link to another one."""
    spark = classes.sparkSession
    facts = classes.select("node", "n", "sketch")
    members = classes.select("node", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = stored(members.join(several, "bucket"), "near-buckets")
    comps = stored(spark.createDataFrame([], "node long, comp long"), "near-comps")
    tested = stored(spark.createDataFrame([], "a long, b long"), "near-pairs")
    for k in range(STAR_ROUNDS):
        # one member of each bucket, the same for buckets with nearly the same members; another one each round
        side = with_comp(members, comps, "node", "comp")
        first = side.groupBy("bucket").agg(F.min_by(F.struct("node", "comp"), F.xxhash64(F.lit(k), "node")).alias("c"))
        pairs = side.join(first, "bucket").where(F.col("comp") != F.col("c.comp"))
        pairs = pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        todo = stored(likely(pairs.join(tested, ["a", "b"], "left_anti"), facts), "near-pairs")
        if not todo.isEmpty():
            comps = grown(comps, confirm(todo, sets_of(ends_of(todo), classes, docs)))
            tested = tested.union(todo)
    split = stored(with_comp(members.select("bucket", "node"), comps, "node", "comp"), "near-split")
    mixed_up = split.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    side = stored(split.join(mixed_up, "bucket").join(facts, "node"), "near-sides")
    links = stored(between(side, classes, docs), "near-links")
    return comps if links.isEmpty() else grown(comps, links)


def likely(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    one = pairs.join(facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    two = one.join(facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    near = estimate(F.col("sa"), F.col("sb")) >= FLOOR
    return two.where(near & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))).select("a", "b")


def between(side: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components whose nodes share a bucket, one per pair of components and tile.

    ``side`` has bucket, node, comp, n and sketch.  A semi join finds the nodes that have any partner by
    sketch in another component.  Nodes connected by buckets form a region; a region is cut into blocks and
    every pair of blocks is a tile, whose task counts the intersections of full sets and emits links only.
    """

    def pick(s: str) -> DataFrame:
        return side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns])

    # the members of a large bucket are compared with one block of them at a time
    large = side.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    side = side.join(small_or_not(stored(large, "near-large")), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x, y = pick("x"), pick("y")
    x = x.withColumn("part_x", F.explode(F.sequence(F.lit(0), F.col("blocks_x") - 1)))
    y = y.withColumn("part_y", F.pmod(F.xxhash64("node_y"), F.col("blocks_y")).cast("int"))
    near = (x["bucket_x"] == y["bucket_y"]) & (x["part_x"] == y["part_y"]) & (F.col("comp_x") != F.col("comp_y"))
    near = near & (100 * F.least("n_x", "n_y") >= PERCENT * F.greatest("n_x", "n_y"))
    near = near & (estimate(F.col("sketch_x"), F.col("sketch_y")) >= FLOOR)
    found = x.join(y, near, "left_semi").select(F.col("node_x").alias("node"), F.col("comp_x").alias("comp"), F.col("n_x").alias("n"))
    active = stored(found.distinct(), "near-active")
    sets = sets_of(active.select("node"), classes, docs)
    held = side.join(active.select("node"), "node", "left_semi").select("bucket", "node")
    first = held.groupBy("bucket").agg(F.min("node").alias("b"))
    regions = components(held.join(first, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    regions = regions.withColumnRenamed("comp", "region")
    placed = active.join(regions, "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("n") / TILE_SHINGLES)).cast("int")
    rows = placed.join(placed.groupBy("region").agg(blocks.alias("blocks")), "region").join(sets, "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "members")
    parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = rows.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j")
    return tiles.mapInPandas(tile_links, "a long, b long")


def tile_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by tile; a tile's rows (two blocks at most) are held together."""
    forget()
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[["region", "i", "j"]].to_numpy()
        edges = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), len(batch)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = batch.iloc[lo:hi]
            if held and (held[-1].iloc[-1][["region", "i", "j"]].tolist() != part.iloc[0][["region", "i", "j"]].tolist()):
                yield links_of(pd.concat(held) if len(held) > 1 else held[0])
                held = []
            held.append(part)
    if held:
        yield links_of(pd.concat(held) if len(held) > 1 else held[0])


def links_of(tile: pd.DataFrame) -> pd.DataFrame:
    """The links between components in one tile, one for each pair of components."""
    node, comp = tile["node"].to_numpy(), tile["comp"].to_numpy()
    size = np.array([len(m) for m in tile["members"]])
    left, right = (np.nonzero(tile["block"].to_numpy() == tile[c].iloc[0])[0] for c in ("i", "j"))
    _, column = np.unique(np.concatenate(list(tile["members"])), return_inverse=True)
    row = np.repeat(np.arange(len(tile)), size)
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, TILE_COLUMNS):
        here = (column >= at) & (column < at + TILE_COLUMNS)
        grid = np.zeros((len(tile), TILE_COLUMNS), np.float32)
        grid[row[here], column[here] - at] = 1
        both += grid[left] @ grid[right].T
    union = size[left][:, None] + size[right][None, :] - both
    p, q = np.nonzero((100 * both >= PERCENT * union) & (comp[left][:, None] != comp[right][None, :]))
    p, q = left[p], right[q]
    low, high = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
    _, one = np.unique(np.stack([low, high]), axis=1, return_index=True) if len(p) else (None, np.empty(0, int))
    return pd.DataFrame({"a": node[p[one]], "b": node[q[one]]})


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, n_shingles, component_id, kept`` for every row.

    Texts without words (NULL, empty, white space) are linked with nothing and kept.  Rows with equal ids or
    equal texts keep a row each; a component's id is its smallest non-NULL doc_id, and ``kept`` compares
    NULL-safe, so components of NULL ids only keep all rows.  Shorter texts than five words are one shingle.
    Empty tables give no row; other columns are ignored.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("binary").alias("raw"))
    rows = stored(profiles(d), "near-profiles")
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    comps = link_classes(classes, d)
    in_comp = classes.select("node", "cls", "least").join(comps, "node")
    head = in_comp.groupBy("comp").agg(F.min("least").alias("head"))
    heads = in_comp.join(head, "comp").select("node", "head")
    final = classes.select("node", "cls", "least").join(heads, "node", "left").select("cls", F.when(F.col("head").isNull(), F.col("least")).otherwise(F.col("head")).alias("component_id"))
    some = rows.where(F.col("cls").isNotNull()).select("doc_id", "n", "cls", "th").join(final, "cls")
    none = rows.where(F.col("cls").isNull()).select("doc_id", "n", "th", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n", "th", "component_id").union(none)
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with the columns of ``docs``.

    NULL and empty texts stay, as in ``near_groups``.  Repeats of a row (same id and text) count as one,
    whatever their other columns hold.  An empty table gives no row.
    """
    kept = near_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th")).distinct()
    id_name, th_name = free_name(docs, "_near_id"), free_name(docs, "_near_th")
    known = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    d = docs.withColumn(id_name, known(doc_id)).withColumn(th_name, F.xxhash64(F.col(text)))
    k = kept.select(known("_kept_id").alias(id_name), F.col("_kept_th").alias(th_name))
    return d.join(k, [id_name, th_name], "left_semi").dropDuplicates([id_name, th_name]).drop(id_name, th_name)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("th")


def near_sql(docs: str) -> str:
    """CTEs ending in ``n_out``: the contract's columns for the rows of ``docs`` (ids unique), by all common shingles."""
    return rf"""
n_doc AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM {docs}),
n_shi AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM
  (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM n_doc WHERE len(w) > 0)),
n_cnt AS (SELECT doc_id, count(*)::BIGINT AS n FROM n_shi GROUP BY doc_id),
n_com AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM n_shi a JOIN n_shi b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
n_lnk AS (SELECT a, b FROM n_com JOIN n_cnt x ON x.doc_id = a JOIN n_cnt y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
n_sym AS (SELECT a, b FROM n_lnk UNION SELECT b, a FROM n_lnk),
n_rch AS (SELECT a AS src, a AS dst FROM n_sym UNION SELECT src, b FROM n_rch JOIN n_sym ON a = dst),
n_min AS (SELECT src, min(dst) AS component_id FROM n_rch GROUP BY src),
n_out AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
  FROM n_doc d LEFT JOIN n_cnt USING (doc_id) LEFT JOIN n_min ON src = d.doc_id)"""


SQL = f"WITH RECURSIVE {near_sql('documents')}\nSELECT * FROM n_out"
