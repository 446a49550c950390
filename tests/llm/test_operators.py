"""Operators against brute force, exact round trips and held-out accuracy."""

import zlib

import numpy as np
import pytest
from conftest import A, view
from pyspark.sql import functions as F

from check_oracle import connect

from trustframe.llm import decontaminate, lines, mixing, neardup, quality, rans, secrets, tokens, toxicity, warc
from trustframe.llm.common import table


def test_trigram_clauses():
    assert secrets.trigram_clauses("[0-9a-f]{24,}") == []
    assert secrets.trigram_clauses("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_clauses(secrets.ASSIGN)
    assert secrets.trigram_clauses("abcd|xy") == []


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """Smallest id per group of rows, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                head[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_rows(seed, groups, copies):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.integers(500)}" for _ in range(r.integers(5, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.integers(0, 9)):
                w[r.integers(len(w))] = f"x{r.integers(40)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("small", [None, "TILE_ROWS", "TILE_SHINGLES"])
def test_near_groups_brute_force(spark, monkeypatch, small):
    if small:  # several blocks per region, column chunks, no broadcast
        monkeypatch.setattr(neardup, small, {"TILE_ROWS": 4, "TILE_SHINGLES": 40}[small])
        monkeypatch.setattr(neardup, "TILE_COLUMNS", 16)
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rows = near_rows(3, 12, 14)
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(rows)


def test_near_groups_edge(spark, edge):
    docs = table(spark, edge, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = neardup.near_groups(docs).collect()
    fill = lambda out, doc: out if out is not None else doc
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((d, n, fill(c, d)) for d, n, c in brute_groups(rows)), key=str)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where(F.lower("text") == A).count() == 1


def test_odd_sketch_estimate(spark):
    r = np.random.default_rng(0)
    for share in (0.6, 0.75, 0.9):
        both = r.integers(0, 2**63, 4000, dtype=np.uint64)
        k = int(4000 * 2 * share / (1 + share)) // 2 * 2
        sets = [np.unique(np.concatenate([both[: k // 2], x])) for x in np.split(r.integers(0, 2**63, 4000 - k, dtype=np.uint64), 2)]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        s = neardup.odd_sketches(neardup.minhashes(sets))
        df = spark.createDataFrame([(s[0].tolist(), s[1].tolist())], "a array<long>, b array<long>")
        assert abs(df.select(neardup.estimate(F.col("a"), F.col("b"))).first()[0] - true) < 0.2


def test_decontaminate_blocks_and_spans(spark, edge):
    docs, items = table(spark, edge, "documents"), table(spark, edge, "benchmark")
    view1 = decontaminate.find(docs, items).withColumn("n", decontaminate.covered(F.col("hits"))).select("key", "n_words", "n", "items").collect()
    view2 = decontaminate.find(docs, items, block_windows=2).withColumn("n", decontaminate.covered(F.col("hits"))).select("key", "n_words", "n", "items").collect()
    assert sorted(map(str, view1)) == sorted(map(str, view2))
    clean = decontaminate.remove_spans(docs, items)
    assert clean.columns == docs.columns
    assert decontaminate.find(clean, items).where(F.size("hits") > 0).count() == 0
    assert decontaminate.remove_documents(docs, items).count() == sum(r.n == 0 for r in view1)


def test_line_runs_levels(spark):
    runs = lines.LineRuns(spark, fan_in=2, buckets=2)
    one = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "doc_id long, h1 long, h2 long")
    for k in range(3):
        runs.add(one.withColumn("doc_id", F.lit(k).cast("long")))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert sorted((r.h1, r.n, r.last) for r in runs.merged().collect()) == [(1, 3, 2), (2, 3, 2)]
    new = spark.createDataFrame([(9, 1, 1), (9, 5, 5)], "doc_id long, h1 long, h2 long")
    assert [r.h1 for r in runs.unseen(new).collect()] == [5]


def test_rans_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 31, 32, 33, rans.BLOCK, rans.BLOCK + 5, 3 * rans.BLOCK + 17):
        ids = np.minimum(r.geometric(0.01, n), 5000)
        t = rans.Table(rans.frequencies(np.bincount(ids)))
        blocks = rans.encode(ids, t)
        assert (rans.decode(blocks, t) == ids).all()
        assert (rans.decode(blocks[-1:], t) == ids[-blocks[-1][0] :]).all()
    bad = [(*blocks[0][:3], blocks[0][3] ^ 1)]
    with pytest.raises(ValueError):
        rans.decode(bad, t)


@pytest.mark.parametrize("which", ["sf", "edge"])
def test_token_files(spark, sf, edge, which):
    from tokenizers import Tokenizer

    docs = table(spark, sf if which == "sf" else edge, "documents")
    extra = spark.createDataFrame([(10**6, "don't <|endoftext|>abc<|startoftext|> I'm É́a Ünï\x1ccode\x85z ΑΣ İI x1!!é ABC, a.b c!d")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    files = tokens.write_tokens(docs, tokens.default_tokenizer(), segment_ids=3000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(files).collect())
    t = Tokenizer.from_file(tokens.default_tokenizer())
    want = {}
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for start, doc, n, crc in got:
        assert start == at
        at += n
        want[doc].remove((n, crc))
    assert not any(want.values())
    assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda x: (x is not None, x or 0))
    part = files.parts.orderBy("shard", "seg").first()
    code = rans.Table(files.freq)
    assert (tokens.read_block(part.file, 0, code) == tokens.read_file(part.file, code)[2][: rans.BLOCK]).all()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    out = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert out.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.97
    assert out.where("toxic = 1").select(F.avg("predicted")).first()[0] > 0.85
    spans = toxicity.score(spark.createDataFrame([(1, "well you idiot and moron"), (2, None), (None, "")], "doc_id long, text string"), model).collect()
    assert sorted(len(r.spans) for r in spans) == [0, 0, 2] and all(0 <= r.score <= 1 for r in spans)


def test_marginals_brute_force():
    r = np.random.default_rng(2)
    e, trans, start = r.normal(size=(1, 6)), r.normal(size=(2, 2)), r.normal(size=2)
    got = toxicity.forward_backward(e, np.ones((1, 6), bool), trans, start)[0]
    total, ones = 0.0, np.zeros(6)
    for code in range(64):
        y = [code >> k & 1 for k in range(6)]
        p = np.exp(start[y[0]] + sum(e[0, k] * y[k] for k in range(6)) + sum(trans[y[k], y[k + 1]] for k in range(5)))
        total, ones = total + p, ones + p * np.array(y)
    assert np.allclose(got, ones / total)


def test_mix_documents_follow_amounts(spark, sf):
    docs = table(spark, sf, "documents").withColumn("skey", F.lit("clash")).withColumn("off", F.lit(1))
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix_amounts(docs).where("taken > 0").collect()}
    words = mix.groupBy("doc_id").agg(F.sum(mixing.sizes(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == taken


def test_warc_edge(spark, edge):
    pages = table(spark, edge, "pages")
    archives = warc.write_archives(pages)
    keys = pages.select(warc.url_key(F.col("url")).alias("key"), "page_id")
    got = warc.lookup(keys, archives).collect()
    assert len(got) == pages.count()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 8} == {(3, "response", None), (5, "revisit", 3), (None, "revisit", 3)}
    assert {r.payload_bytes for r in got} == {8, 0, 100_000}
    index = warc.CaptureIndex([tuple(r) for r in archives.select("key", "page", "path", "dir_at").collect()])
    assert len(index.captures("b,a)/c?d")) == 3 and index.captures("b,a)/none") == []


def test_quality_keeps_columns(spark, edge):
    docs = table(spark, edge, "documents")
    assert quality.keep_good(docs).columns == docs.columns


def test_pipeline_stages(spark, tmp_path):
    """Every stage against SQL or brute force on its own input."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    con = connect(sf)
    docs = table(spark, sf, "documents")
    for k, (_, stage) in enumerate(c.STAGES):
        view(con, "documents", docs)
        out = c.stored(stage(spark, docs, sf), "test-stage")
        if k < 4:
            assert out.columns == docs.columns
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if k == 0:
            want = con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept ORDER BY 1").fetchall()
        elif k == 1:
            want = con.execute(f"SELECT doc_id FROM ({neardup.SQL}) WHERE kept ORDER BY 1").fetchall()
        elif k == 2:
            want = con.execute(f"SELECT doc_id FROM ({decontaminate.SQL}) WHERE NOT contaminated ORDER BY 1").fetchall()
        elif k == 3:
            want = con.execute(f"SELECT doc_id FROM ({mixing.SQL}) WHERE taken > 0 ORDER BY 1").fetchall()
            ids = sorted(set(ids))
        else:
            want = [(r.doc_id,) for r in docs.select("doc_id").orderBy("doc_id").collect()]
        assert ids == [w[0] for w in want], k
        docs = out
