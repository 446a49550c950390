"""Ids above 2^53 beside NULL, and string ids, come back as they went in."""

import pytest
from conftest import A
from pyspark.sql import functions as F

from trustframe.llm import decontaminate, licenses, lines, mixing, neardup, quality, secrets, tokens, toxicity, warc

BIG = 2**60
IDS = [BIG + 1, BIG + 3, None, BIG + 5]
TEXTS = ["first text of its own with some words", "another one that shares nothing", "third text is different again", A]
MODEL = []


def model(spark):
    if not MODEL:
        MODEL.append(toxicity.fit([("you idiot", 1), ("a moron you are", 1), ("fine day to all", 0), ("good words here", 0)] * 5))
    return MODEL[0]


def tokenized(docs):
    kind = docs.schema["doc_id"].dataType.simpleString()
    return tokens.read_tokens(tokens.write_tokens(docs, tokens.default_tokenizer()), kind)


RUNS = {
    "op1": lambda d, b: secrets.scan(d),
    "op2": lambda d, b: toxicity.score(d, model(d.sparkSession)),
    "op3": lambda d, b: tokenized(d),
    "op4": lambda d, b: decontaminate.find(d, b),
    "op4 keep": lambda d, b: decontaminate.remove_documents(d, b.where("item_id < 0")),
    "op5": lambda d, b: lines.dedup(d),
    "op6": lambda d, b: neardup.near_groups(d),
    "op6 keep": lambda d, b: neardup.keep_one(d),
    "op7 keep": lambda d, b: quality.keep_good(d.withColumn("text", F.lit(" ".join(f"the word{k} and" for k in range(20))))),
    "op8": lambda d, b: mixing.mix_amounts(d),
    "op9": lambda d, b: licenses.scan(d, licenses.known_digests(d.sparkSession)),
}


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("name", sorted(RUNS))
def test_ids_survive(spark, name, kind):
    ids = [None if i is None else kind(i) for i in IDS]
    rows = [(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(zip(ids, TEXTS))]
    docs = spark.createDataFrame(rows, f"doc_id {'long' if kind is int else 'string'}, text string, lang string, source string, n_chars long").coalesce(1)
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    got = [r.doc_id for r in RUNS[name](docs, bench).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)


@pytest.mark.parametrize("kind", [int, str])
def test_page_ids_survive(spark, kind):
    pages = [(BIG + 1, "http://a.b/x", "<p>one</p>"), (BIG + 3, "http://a.b/y", "<p>one</p>"), (None, "http://a.b/z", "<p>one</p>"), (BIG + 9, "http://c.d/", "<p>two</p>")]
    pages = [(None if i is None else kind(i), u, h) for i, u, h in pages]
    if kind is str:
        pages += [("id > with\r\nbreaks: 100%", "http://e.f/", "three"), ("none", "http://e.f/", "three"), ("", "http://e.f/", "three")]
    df = spark.createDataFrame(pages, f"page_id {'long' if kind is int else 'string'}, url string, html string").coalesce(1)
    archives = warc.write_archives(df)
    got = warc.lookup(df.select(warc.url_key(F.col("url")).alias("key"), "page_id"), archives).collect()
    assert sorted((r.page_id for r in got), key=str) == sorted((p[0] for p in pages), key=str)
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    want = {(i, least[h] if i != least[h] and sum(p[2] == h for p in pages) > 1 else None) for i, _, h in pages}
    assert {(r.page_id, r.refers_to) for r in got} == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)


def test_components_of_large_ids_exist(spark):
    rows = [(BIG + 7, A), (BIG + 5, A + " more"), (None, A), (BIG + 11, "unrelated text with its own words"), (None, "and one more that is unlike the others")]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(BIG + 7, BIG + 5), (BIG + 5, BIG + 5), (None, BIG + 5), (BIG + 11, BIG + 11), (None, None)}


def test_cut_spans_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x " + A + " y", "a", "b", "c"), (2, "none", "d", "e", "f")], "doc_id long, text string, _cut_text string, _cut_key string, key string")
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    got = decontaminate.remove_spans(docs, bench)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text.split(), r._cut_text) for r in got.collect()) == [(1, ["x", "y"], "a"), (2, ["none"], "d")]
    assert [r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()] == [2]
